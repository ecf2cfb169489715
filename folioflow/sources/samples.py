"""Texts to run the text functions on: every line of documents, and fixed cases in scripts that the tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = [
    "나무(표3:1)", "갔다(가) 또(나) 왔다.", "겹친(하나(둘)셋) 글", "넓은（괄호）글", "(모두 괄호)", "글이 끝났다 (보기).", "(((", "a)b(", "열림( 안 닫힘",
    "하x늘이 맑습니다.", "ㅁㅁㅁㅁ …", "상한 � 글", "바람부는언덕에올라먼바다를보았다네", "제7장 여름 바다", "R ←", "P ∠", "G →", "L", "푸른 언덕", "맞는다.",
    "바다노래를듣는다", "  여백　있는 글 ,  끝 。", "a  b\t\tc !", "", "   ", "<b>&'\"</b>", "bad\x01char\x0b", "A4용지", "3장", "IV", ";", "8", "②", "½", "tel", "abc", "...", "12", "ㄱ", "", "정상 문장입니다.", "", "\U000f0001", "a b  .", " c 　\x85\xa0d ", "x ", "등은 크다", "책을",
]


def sql_text(value: str) -> str:
    """A DuckDB expression for a string, with characters beyond printable ones by number."""
    parts = ["'" + c.replace("'", "''") + "'" if c.isprintable() or c in " " else f"chr({ord(c)})" for c in value]
    return "(" + " || ".join(parts or ["''"]) + ")"


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CASES)), "id long, text string").withColumn("part", F.lit("case")).select("part", "id", "text")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, id, text: the cases, and the lines of documents by doc_id * 2 ** 20 + line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    lines = lines.select(F.lit("line").alias("part"), (F.col("doc_id") * (1 << 20) + F.col("line")).alias("id"), "text")
    return cases(spark).unionByName(lines)


SAMPLES_SQL = (
    "samples AS (SELECT 'case' AS part, CAST(id AS BIGINT) AS id, text FROM (VALUES "
    + ", ".join(f"({i}, {sql_text(t)})" for i, t in enumerate(CASES))
    + ") v(id, text) UNION ALL SELECT 'line', doc_id * 1048576 + line, text FROM (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS line"
    " FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"
)
