"""Inputs for the registered queries, derived row by row from the given tables.

Every builder is a plain projection of one table, so its size follows the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramill.functions.text import sql_literal
from paramill.session import spread
from paramill.sources.training import FILE_ORDER, in_file_order


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# neutral text between sentences, longer than any window
FILLER = "The survey crew kept careful notes during the visit and nothing unusual happened near the bank. "

# (text before the number, kind of number, text after it); n is 1..40, y a year, p a price
SENTENCES: list[tuple[str, str, str]] = [
    ("Influent COD was ", "n", " mg/L. "),
    ("Effluent total nitrogen reached ", "p", " ug/L. "),
    ("HRT was kept at ", "n", " d. "),
    ("The hydraulic loading rate was ", "frac", " m³/(m²·d). "),
    ("Influent BOD5 ranged over ", "range", " mg/L. "),
    ("HRT was listed as ", "n", " mg/L. "),
    ("The basin length came to ", "n", ", as drawn. "),
    ("Effluent pH stayed at ", "half", " all day. "),
    ("TP was first studied in ", "y", ". "),
    ("COD as noted over the whole visit was ", "n", " mg/L. "),
    ("进水 氨氮 约为 ", "n", " mg/L。"),
    ("The air temperature fell to ", "minus", " °C. "),
    ("Some ", "n", " mg/L of ammonia nitrogen left the outlet. "),
    ("Crews planted ", "n", " stems by hand. "),
    ("Removal efficiency for COD came to ", "n", " %. "),
    ("DO was ", "n", " g/m3. "),
]


_N = "(1 + o_orderkey % 40)"
_NUMBER = {
    "n": _N,
    "p": "cast(o_totalprice as decimal(14,2))",
    "frac": "concat('0.', lpad(cast(1 + o_orderkey % 97 as string), 2, '0'))",
    "range": f"concat({_N}, '~', {_N} + 10)",
    "half": f"concat({_N}, '.5')",
    "y": "(1990 + o_orderkey % 30)",
    "minus": f"concat('-', {_N})",
}


def _sentence(which: str) -> str:
    """SQL for the sentence with the number ``which``."""
    cases = " ".join(
        f"WHEN {i} THEN concat({sql_literal(before)}, {_NUMBER[kind]}, {sql_literal(after)})"
        for i, (before, kind, after) in enumerate(SENTENCES)
    )
    return f"CASE {which} {cases} END"


#: Rows of narrow tables that a task of CPU-heavy work takes.
TASK_ROWS = 50_000


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", TASK_ROWS)


def report_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One page of report text per order; the documents are the customers."""
    count, filler = len(SENTENCES), sql_literal(FILLER)
    first = _sentence(f"o_orderkey % {count}")
    second = _sentence(f"(o_orderkey div {count} + o_custkey) % {count}")
    return _orders(spark, folder).selectExpr(
        "concat('study_', o_custkey, '.pdf') AS pdf_name",
        "o_orderkey + 1 AS page",
        f"concat({filler}, {first}, {filler}, {second}, {filler}) AS text",
    )


def listed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The report pages as two overlapping lists of files give them: a third of the documents comes
    twice, and there are pages without text."""
    pages = report_pages(spark, folder)
    again = pages.where("pmod(hash(pdf_name), 3) = 0")
    blank = _orders(spark, folder).selectExpr("concat('study_', o_custkey, '.pdf') AS pdf_name", "-o_orderkey AS page", "cast(NULL AS string) AS text")
    return pages.unionByName(again).unionByName(blank)


def _woven(rows: DataFrame) -> DataFrame:
    """pdf_name, page, text with a known sentence after each text; the sentence depends on
    ``o_orderkey`` and ``o_totalprice`` of the row."""
    filler = sql_literal(FILLER)
    sentence = _sentence(f"o_orderkey % {len(SENTENCES)}")
    return rows.selectExpr("pdf_name", "page", f"concat(coalesce(text, ''), '\\n\\n', {filler}, {sentence}, {filler}) AS text")


def woven_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole given documents, each followed by a sentence of the report pages."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    return _woven(
        docs.selectExpr("concat('doc_', doc_id) AS pdf_name", "1L AS page", "text", "doc_id AS o_orderkey", "n_chars + 0.5D AS o_totalprice")
    )


def woven_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Whole given conversations, a page per turn, each turn followed by a sentence."""
    return _woven(
        table(spark, folder, "conversations").selectExpr(
            "concat('conv_', conv_id) AS pdf_name", "turn + 1 AS page", "text", "conv_id * 10 + turn AS o_orderkey",
            "conv_id + 0.25D AS o_totalprice",
        )
    )


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The given documents, one page each, whole texts."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("pdf_name"),
        F.lit(1).alias("page"),
        "text",
    )


def first_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The first sentence of every page with the place of its number."""
    which = f"o_orderkey % {len(SENTENCES)}"
    places = ", ".join(str(len(before)) for before, _, _ in SENTENCES)
    return _orders(spark, folder).selectExpr(
        "o_orderkey",
        f"{_sentence(which)} AS text",
        f"element_at(array({places}), cast({which} + 1 AS int)) AS value_pos",
    )


def training_rows(spark: SparkSession, folder: str, task_rows: int | None = None) -> DataFrame:
    """A training table per line item: gaps, outliers, a constant and a nearly empty column.

    With ``task_rows`` the rows are dealt to tasks of about as many.
    """
    key = F.col("l_orderkey")
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"
    )
    items = spread(items, "l_orderkey", task_rows) if task_rows else items
    return items.select(
        F.col("l_suppkey").cast("string").alias("source_id"),
        F.when(key % 7 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(key % 97 == 0, F.col("l_extendedprice") * 50).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(key % 5 != 1, F.col("l_discount")).alias("discount"),
        F.lit(5.0).alias("constant"),
        F.when(key % 31 == 0, F.col("l_tax")).alias("sparse"),
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted_candidate").alias("quality_status"),
        F.when(F.col("l_linestatus") == "O", "approved")
        .when(F.col("l_linenumber") == 1, "confirmed")
        .otherwise("pending")
        .alias("review_status"),
    )


def designs(spark: SparkSession, folder: str) -> DataFrame:
    """A design per part, as raw text: blanks, aliases, bad numbers, values out of range."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    parts = spread(table(spark, folder, "part").select("p_partkey"), "p_partkey", TASK_ROWS)
    return parts.select(
        k.alias("design_id"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, " 12.5 ").when(k % 7 == 2, "abc")
        .otherwise((5 + k % 50).cast("string")).alias("长"),
        F.when(k % 11 == 0, "0.05").otherwise(F.concat((2 + k % 9).cast("string"), F.lit(".5"))).alias("宽"),
        F.when(k % 13 == 0, "25").otherwise("1.5").alias("高"),
        F.when(k % 5 == 0, "水平潜流").when(k % 5 == 1, " Vertical ").when(k % 5 == 2, none)
        .when(k % 5 == 3, "diagonal").otherwise("horizontal").alias("flow_type"),
        F.when(k % 6 == 0, "2.5").when(k % 6 == 1, none).otherwise((1 + k % 8).cast("string")).alias("compartments"),
        F.when(k % 4 == 0, none).when(k % 4 == 1, "1.6").otherwise("0.8").alias("water_depth"),
        F.when(k % 17 == 0, "1.4").otherwise(none).alias("wall_thickness"),
        F.when(k % 3 != 0, F.concat((10 + k % 30).cast("string"), F.lit(".3"))).alias("水力停留时间"),
        F.when(k % 2 == 0, "7.25").otherwise("site a").alias("note"),
    )


def old_and_new_training(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two training tables that share some documents and some columns."""
    items = table(spark, folder, "lineitem").withColumn(
        "pdf_name", F.concat(F.lit("study_"), F.col("l_suppkey").cast("string"), F.lit(".pdf"))
    )
    old = items.where("l_linenumber <= 4 or l_suppkey % 3 <> 0").groupBy("pdf_name").agg(
        F.count("*").alias("a"), F.sum("l_quantity").alias("b")
    )
    new = items.where("l_linenumber > 4 and l_suppkey % 3 = 0").groupBy("pdf_name").agg(
        F.count("*").alias("a"), F.max("l_extendedprice").alias("c")
    )
    return old, new


def repeated_keys(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two training tables with several rows per document, in the order in which the file has them."""
    items = in_file_order(spark.read.parquet(f"{folder}/lineitem.parquet"))
    rows = items.select(
        F.concat(F.lit("study_"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("pdf_name"),
        F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")).alias("c"), FILE_ORDER,
    )
    return rows.where("line % 2 = 1").drop("line", "c"), rows.where("line % 2 = 0").drop("line", "b")
