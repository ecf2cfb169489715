"""Document-flow analytics expressed as DataFrame and Column functions."""
