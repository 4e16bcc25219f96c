"""Supplier price-list feeds: CSV reading per registry entry, header mapping and intake checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header words per field, most telling first.
COLUMN_WORDS = {
    "article": ["код товара поставщика", "код товара", "артикул", "article", "code"],
    "name": ["название", "наименование", "товар", "name", "product"],
    "supplier": ["поставщик", "supplier"],
    "unit": ["единица", "ед. изм.", "ед.", "unit"],
    "pack_qty": ["количество в упаковки", "количество в упаковке", "кол-во в месте", "pack_qty"],
    "min_order": ["минимальный заказ", "мин. заказ", "min_order"],
    "price": ["цена за единицу", "цена", "price", "стоимость"],
}
# Headings of names proper, and of codes.
NAME_FIRST = ["название", "наименование"]
CODE_WORDS = ["код", "артикул", "sku", "code", "article"]
HEADER_ROWS = 5
#: Separators in the order in which they are tried.
SEPARATORS = [";", ",", "\t", "|"]


@dataclass(frozen=True)
class Feed:
    """Registry entry of one supplier's feed. An empty separator or encoding is found by a look at the files."""

    supplier_id: str
    path: str
    sep: str = ","
    encoding: str = "UTF-8"
    columns: dict[str, str] = field(default_factory=dict)


# Upper halves of Latin-1 and Windows-1251. Spark reads the former but not the latter, so such files are read as Latin-1
# and their letters are mapped.
_HIGH = bytes(b for b in range(0x80, 0x100) if b != 0x98)
LATIN_1, CYRILLIC = _HIGH.decode("latin-1"), _HIGH.decode("cp1251")


def map_header(cells: list[str]) -> dict[str, int]:
    """Field to column position; a column serves one field, and a field takes its first fitting column."""
    out: dict[str, int] = {}
    for position, cell in enumerate(cells):
        text = (cell or "").lower().strip()
        for name, words in COLUMN_WORDS.items():
            if name not in out and any(w in text for w in words):
                out[name] = position
                break
    return out


def find_header(rows: list[list[str]]) -> tuple[int, dict[str, int]] | None:
    """First of the top rows that names both the product and the price."""
    for i, cells in enumerate(rows[:HEADER_ROWS]):
        mapping = map_header(cells)
        if "name" in mapping and "price" in mapping:
            return i, mapping
    return None


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """Per file below ``path``: encoding, separator, fields of a row and lines, from one pass over its lines.

    A file with a line that is no UTF-8 is taken for Windows-1251. Of the separators the one wins under which most lines have
    the same number of fields, two at least; the first in ``SEPARATORS`` of equals. Text in quotes doesn't count. A file of
    one column has no separator.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    plain = F.regexp_replace(F.make_valid_utf8("value"), '"[^"]*"', "")
    fields = lambda sep: F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1
    counts = F.array(*(F.struct(F.lit(k).alias("sep"), fields(sep).alias("n_fields")) for k, sep in enumerate(SEPARATORS)))
    seen = lines.select("file", (~F.is_valid_utf8("value")).cast("int").alias("bad"), F.explode(counts).alias("c"))
    shapes = seen.groupBy("file", "c.sep", "c.n_fields").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    best = shapes.groupBy("file").agg(
        F.max(F.when(F.col("n_fields") > 1, F.struct("n", (-F.col("sep")).alias("sep"), "n_fields"))).alias("b"),
        F.sum(F.when(F.col("sep") == 0, F.col("n"))).alias("n_lines"), F.sum("bad").alias("bad"),
    )
    sep = F.get(F.array(*map(F.lit, SEPARATORS)), -F.col("b.sep"))
    return best.select("file", F.when(F.col("bad") > 0, "cp1251").otherwise("UTF-8").alias("encoding"), sep.alias("sep"), F.coalesce("b.n_fields", F.lit(1)).alias("n_fields"), "n_lines")


def raw_cells(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """Cells as text (columns _c0, _c1, ...), with the ``file``, the line order in it as ``row_no``, and whether the row may be a heading."""
    cyrillic = encoding.lower() in ("cp1251", "windows-1251")
    raw = spark.read.option("sep", sep).option("encoding", "ISO-8859-1" if cyrillic else encoding).option("quote", '"').csv(path)
    cells = [F.translate(F.col(c), LATIN_1, CYRILLIC).alias(c) if cyrillic else F.col(c) for c in raw.columns]
    rows = raw.select(*cells, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_no"), (F.col("_metadata.file_block_start") == 0).alias("_top"))
    # Rows of a file's first block follow each other from its first line on, wherever Spark put the block.
    first = rows.filter("_top").groupBy("file").agg(F.min("row_no").alias("_first"))
    return rows.join(first, "file", "left").withColumn("top", F.when(F.col("_top"), F.col("row_no") - F.col("_first") < HEADER_ROWS).otherwise(False)).drop("_top", "_first")


def choose_columns(head: list[list[str]], names: list[str], profile: dict[str, float]) -> tuple[int, dict[str, int]] | None:
    """Heading row and column of every field; of several columns with a name's heading the one that looks most like names.

    ``profile`` gives each column's mean length times its share of values that are no numbers. Headings of codes and of
    suppliers are never names.
    """
    found = find_header(head)
    if found is None:
        return None
    row, mapping = found
    titles = [(c or "").lower().strip() for c in head[row]]
    rated = []
    for k, title in enumerate(titles):
        if any(w in title for w in CODE_WORDS) or any(w in title for w in COLUMN_WORDS["supplier"]):
            continue
        rank = 2 if any(w in title for w in NAME_FIRST) else 1 if any(w in title for w in COLUMN_WORDS["name"]) else 0
        if rank:
            rated.append((rank + 0.1 * profile.get(names[k], 0.0), -k))
    if rated:
        chosen = -max(rated)[1]
        mapping = {f: k for f, k in mapping.items() if k != chosen} | {"name": chosen}
    return row, mapping


def read_feed(spark: SparkSession, feed: Feed) -> DataFrame:
    """Rows of a feed (a file, or a folder of files of one layout) as text columns named by field, with the line order as ``row_no``.

    An empty separator or encoding of the registry entry is found by ``layouts``. Only the heading candidates of the first
    file and a number for each column come to the driver; the rows stay on Spark.
    """
    sep, encoding = feed.sep, feed.encoding
    if not sep or not encoding:
        told = layouts(spark, feed.path).orderBy(F.desc("n_lines"), "file").first()
        sep, encoding = sep or told["sep"] or ",", encoding or told["encoding"]
    raw = raw_cells(spark, feed.path, sep, encoding)
    names = [c for c in raw.columns if c not in ("file", "row_no", "top")]
    tops = raw.filter("top")
    one = tops.agg(F.min("file")).first()[0]
    head = [list(r)[: len(names)] for r in tops.filter(F.col("file") == one).orderBy("row_no").select(*names, "row_no").collect()]
    profile = {r["column"]: r["name_score"] for r in profile_columns(raw.filter("NOT top").select(*names)).collect()}
    found = choose_columns(head, names, profile)
    if found is None and not feed.columns:
        raise ValueError("no header row with product and price")
    position, mapping = found if found else (0, {})
    for name, column in feed.columns.items():
        titles = [(c or "").strip().lower() for c in head[position]]
        mapping[name] = titles.index(column.lower())
    line = lambda cells: F.concat_ws("\u0001", *cells)
    heading = line([F.coalesce(F.col(c), F.lit("")) for c in names]).isin(["\u0001".join((c or "") for c in row) for row in head[: position + 1]])
    body = raw.filter(~(F.col("top") & heading))
    fields = [F.col(names[mapping[n]]).alias(n) if n in mapping else F.lit(None).cast("string").alias(n) for n in COLUMN_WORDS]
    return body.select(F.lit(feed.supplier_id).alias("supplier_id"), "row_no", *fields)


def profile_columns(raw: DataFrame) -> DataFrame:
    """Per column: how much it looks like a name — mean length times the share that is not a number."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw.columns]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), t.alias("value")) for c, t in zip(raw.columns, text)])
    numeric = F.col("c.value").rlike(r"^\s*[\d\s.,]+\s*$").cast("double")
    out = raw.select(F.explode(cells).alias("c")).groupBy("c.column").agg(
        F.avg(F.length("c.value")).alias("mean_length"), F.avg(numeric).alias("numeric_share")
    )
    score = F.when(F.col("numeric_share") > 0.9, 0.0).otherwise(F.col("mean_length") * (1 - F.col("numeric_share")))
    return out.withColumn("name_score", score)


def intake_checks(raw: DataFrame, files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Reason to refuse each file of ``raw`` (file, columns of text), or null.

    ``files`` holds file, supplier_id, checksum and column_names; ``loaded`` the (supplier_id, checksum) seen before.
    """
    rows = raw.groupBy("file").agg(F.count("*").alias("n_rows"))
    seen = loaded.select("supplier_id", "checksum").distinct().withColumn("seen", F.lit(True))
    names = F.col("column_names")
    reason = (
        F.when(F.col("seen"), "ALREADY_LOADED")
        .when(F.coalesce("n_rows", F.lit(0)) == 0, "NO_ROWS")
        .when(F.size(names) == 0, "COLUMN_COUNT")
        .when(F.exists(names, lambda n: F.coalesce(F.trim(n), F.lit("")) == ""), "UNNAMED_COLUMN")
        .when(F.size(F.array_distinct(names)) < F.size(names), "DUPLICATE_COLUMN")
    )
    return files.join(rows, "file", "left").join(seen, ["supplier_id", "checksum"], "left").select(
        "file", "supplier_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), reason.alias("refused")
    )


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Path and sha256 of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("checksum"))


def read_dictionary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rule or brand dictionary from CSV with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)
