"""What an outside judge may answer: a form made of the features that are on, as a JSON schema for the judge and as a check of its text.

A response is one JSON object with one list. It counts as a whole: text that is no JSON, another name, an item without one of
the form's fields or with one more, a value of another type or outside its choices, or other ids than were asked, once each,
make all of the batch's questions go unanswered.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXTS = {"type": "array", "items": {"type": "string"}}
_NUMBER = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
_EDIT = f"OBJECT<after: STRING, before: STRING, confidence: {_NUMBER}, reason: STRING>"


@dataclass(frozen=True)
class Field:
    """A field of an item: its JSON schema, its type as `schema_of_variant` names it, and what else holds of its value."""

    schema: dict
    type: str
    choices: tuple = ()
    each: str = ""


_NO_MORE = {"type": "object", "additionalProperties": False}
# Fixed values
FIELDS = {
    "ocr_words": ("ocr_edits", Field({"type": "array", "items": _NO_MORE | {"properties": {"before": {"type": "string"}, "after": {"type": "string"}, "confidence": {"type": "number"}, "reason": {"type": "string"}}, "required": ["before", "after", "confidence", "reason"]}}, r"ARRAY<(?:VOID|OBJECT<.*>)>", each=_EDIT)),
    "spacing": ("spacing_text", Field({"type": ["string", "null"]}, "(?:STRING|VOID)")),
    "anomalies": ("anomalies", Field(_TEXTS, "ARRAY<(?:VOID|STRING)>")),
    "structure": ("kind", Field({"type": "string", "enum": ["unchanged", "body", "heading", "footnote", "page_element"]}, "STRING", ("unchanged", "body", "heading", "footnote", "page_element"))),
    "headings": ("heading_level", Field({"type": "integer", "minimum": 0, "maximum": 3}, "BIGINT", (0, 1, 2, 3))),
    "glosses": ("remove_glosses", Field(_TEXTS, "ARRAY<(?:VOID|STRING)>")),
    "figures": ("figure_residue", Field({"type": "boolean"}, "BOOLEAN")),
}
RULE = "custom_rule:"
LONGEST_RULE = 600


@dataclass(frozen=True)
class Form:
    """The name of the list, and the fields of its items beside id."""

    outer: str
    fields: dict[str, Field] = field(default_factory=dict)

    @property
    def schema(self) -> dict:
        properties = {"id": {"type": "integer"}} | {name: f.schema for name, f in self.fields.items()}
        return _NO_MORE | {"properties": {self.outer: {"type": "array", "items": _NO_MORE | {"properties": properties, "required": list(properties)}}}, "required": [self.outer]}

    def fits(self, item: Column) -> Column:
        """Whether a variant has exactly the form's fields, of their types, and their values are among the choices."""
        types = {"id": "BIGINT"} | {name: f.type for name, f in self.fields.items()}
        shape = "^OBJECT<" + ", ".join(f"{name}: {types[name]}" for name in sorted(types)) + ">$"
        is_a = lambda pattern: lambda x: F.schema_of_variant(x).rlike(f"^{pattern}$")
        rules = [F.schema_of_variant(item).rlike(shape)]
        for name, f in self.fields.items():
            if f.choices:
                kind = "string" if isinstance(f.choices[0], str) else "bigint"
                rules.append(F.try_variant_get(item, f"$.{name}", kind).isin(*f.choices))
            if f.each:
                rules.append(F.forall(F.try_variant_get(item, f"$.{name}", "array<variant>"), is_a(f.each)))
        return F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False))


def enhance_form(features) -> Form:
    """The form of answers about paragraphs: fields of the features that are on, and no others. Names of none are an error."""
    known = [f for f in features if not f.startswith(RULE)]
    if wrong := sorted(set(known) - set(FIELDS)):
        raise ValueError(f"no such features: {', '.join(wrong)}")
    return Form("items", dict(FIELDS[f] for f in FIELDS if f in known))


BOUNDARIES = Form("decisions", {"join": Field({"type": "boolean"}, "BOOLEAN")})
CHANGES = Form("items", {"action": Field({"type": "string", "enum": ["keep", "replace", "delete"]}, "STRING", ("keep", "replace", "delete")), "text": Field({"type": ["string", "null"]}, "(?:STRING|VOID)")})


def with_rule(features, rule: str) -> list[str]:
    """Features and a caller's own rule, at most LONGEST_RULE characters of it; its words are part of what a cached answer hangs on."""
    rule = rule.strip()[:LONGEST_RULE]
    return [*features, *([RULE + rule] if rule else [])]


def checked(responses: DataFrame, form: Form) -> DataFrame:
    """responses (text, ids: those asked) with items (variants) and problem: what is wrong with the response, null for none."""
    v = F.try_parse_json("text")
    # the list itself is read only of what is JSON; anything else has no list
    items = F.try_variant_get(v, f"$.{form.outer}", "array<variant>")
    rows = responses.withColumn("items", items)
    said = F.array_sort(F.transform("items", lambda x: F.try_variant_get(x, "$.id", "bigint")))
    wrong = (
        F.when(v.isNull(), "no json").when(F.col("items").isNull() | (F.array_sort(F.json_object_keys("text")) != F.array(F.lit(form.outer))), "no list")
        .when(~F.forall("items", form.fits), "fields").when(said != F.array_sort(F.transform("ids", lambda x: x.cast("bigint"))), "ids")
    )
    return rows.withColumn("problem", wrong)


def answers(responses: DataFrame, form: Form) -> DataFrame:
    """book_id, batch, id, answer (an item as JSON) of the responses that are right as a whole."""
    rows = checked(responses, form).where("problem is null").select("book_id", "batch", F.explode("items").alias("item"))
    return rows.select("book_id", "batch", F.try_variant_get("item", "$.id", "int").alias("id"), F.to_json("item").alias("answer"))
