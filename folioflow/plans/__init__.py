"""Registered queries, with SQL written from each rule's text rather than from the DataFrame code."""
