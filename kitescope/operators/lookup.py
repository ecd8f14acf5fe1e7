"""Lookups and schema summaries over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kitescope.functions.naming import column_category, contains_any
from kitescope.operators.search import phrase_matches, top_by

TYPE_ORDER = ["fact", "dimension", "reference"]


def search_tables(tables: DataFrame, text: str, limit: int = 20, table_type: str | None = None) -> DataFrame:
    """L1 for one text: name or description contains it (any case), type must agree, first by name."""
    low = text.lower()
    hit = F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(low))
    if table_type is not None:
        hit = hit & (F.col("table_type") == table_type)
    return tables.filter(hit).orderBy("name").limit(limit)


def search_tables_batch(tables: DataFrame, questions: DataFrame, limit: int = 20) -> DataFrame:
    """L1 for many questions; a question with ``table_type`` only finds tables of that type."""
    found = phrase_matches(questions, tables, ["name", "description"]).join(tables.select("name", "table_type"), "name")
    if "table_type" in questions.columns:
        wanted = questions.select("question_id", F.col("table_type").alias("wanted_type"))
        found = found.join(wanted, "question_id").filter(F.col("wanted_type").isNull() | (F.col("wanted_type") == F.col("table_type")))
    return top_by(found.select("question_id", "name", "table_type"), ["question_id"], ["name"], limit)


def table_details(tables: DataFrame, columns: DataFrame | None, names: DataFrame | None = None) -> DataFrame:
    """L2: table rows with their ordered list of column structs; unknown names give no row.

    Without ``columns`` the tables hold their own in ``columns``, as metadata documents do, and nothing is shuffled for them.
    """
    wanted = tables if names is None else tables.join(names.select("name").distinct(), "name", "left_semi")
    if columns is None:
        fields = ["ordinal_position", "name", "data_type", "description", "is_primary_key", "is_foreign_key"]
        whole = lambda x: F.struct(*[(F.coalesce(x[f], F.lit("")) if f == "description" else x[f]).alias(f) for f in fields])
        listed = F.sort_array(F.transform("columns", whole))
        joined = wanted.withColumn("columns", F.when(F.size(listed) > 0, listed))
    else:
        kept = columns if names is None else columns.join(names.select(F.col("name").alias("table_name")).distinct(), "table_name", "left_semi")
        grouped = kept.groupBy("table_name").agg(
            F.array_sort(F.collect_list(F.struct("ordinal_position", "name", "data_type", F.coalesce("description", F.lit("")).alias("description"),
                                                 "is_primary_key", "is_foreign_key"))).alias("columns")
        )
        joined = wanted.join(grouped, F.col("name") == F.col("table_name"), "left")
    return joined.select(
        "name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("table_type", F.lit("")).alias("table_type"), "record_count", "columns"
    )


def table_columns(columns: DataFrame, table_name: str | None = None) -> DataFrame:
    """L3: columns ordered by name, of one table or of all."""
    chosen = columns if table_name is None else columns.filter(F.col("table_name") == table_name)
    return chosen.select("table_name", "name", "data_type", "description").orderBy("table_name", "name")


def list_tables(tables: DataFrame) -> DataFrame:
    """L4: names and types in order."""
    return tables.select("name", "table_type").orderBy("name")


def ddl_context(details: DataFrame, with_counts: bool = False) -> DataFrame:
    """CREATE TABLE text with comments per detailed table; the variant adds row counts and keys."""
    def line(col: Column) -> Column:
        parts = [F.lit("  "), col["name"], F.lit(" "), col["data_type"]]
        if with_counts:
            parts.append(F.when(col["is_primary_key"], F.lit(" PRIMARY KEY")).otherwise(F.lit("")))
            parts.append(F.when(col["is_foreign_key"], F.lit(" -- Foreign Key")).otherwise(F.lit("")))
        parts.append(F.when(col["description"] != "", F.concat(F.lit(" -- "), col["description"])).otherwise(F.lit("")))
        return F.concat(*parts)

    head = F.concat(F.lit("-- "), F.col("name"), F.lit(" ("), F.col("table_type"), F.lit(")"))
    about = F.when(F.col("description") != "", F.concat(F.lit("-- Description: "), F.col("description")))
    count = F.concat(F.lit("-- Records: "), F.coalesce(F.col("record_count").cast("string"), F.lit("Unknown"))) if with_counts else F.lit(None).cast("string")
    body = F.when(
        F.size(F.coalesce("columns", F.array())) > 0,
        F.concat(F.lit("CREATE TABLE "), F.col("name"), F.lit(" (\n"), F.array_join(F.transform("columns", line), ",\n"), F.lit("\n);")),
    )
    return details.select("name", F.concat_ws("\n", head, about, count, body).alias("ddl"))


KEY_CATEGORIES = ["id", "key", "code"]


def _named_like(words: list[str]) -> Column:
    return contains_any(F.lower("name"), words)


def schema_summary_keys(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per table its key-like columns and those named like date or trader; others are left out."""
    kept = columns.filter(F.col("column_category").isin(KEY_CATEGORIES) | _named_like(["date", "trader"]))
    listed = kept.groupBy("table_name").agg(F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY name)").alias("key_columns"))
    return listed.join(tables, F.col("table_name") == F.col("name")).select("name", "description", "key_columns")


TYPED_WORDS = ["date", "trader", "product", "price", "currency"]
BROAD_WORDS = ["trader", "product", "price", "currency", "venue", "notional", "cusip", "ticker"]


def schema_summary_typed(
    tables: DataFrame, columns: DataFrame | None, broad: bool = False, limit: int | None = None, description_chars: int | None = None,
    column_chars: int | None = None,
) -> DataFrame:
    """As L6 with type, distinct column list and the number of columns that qualified.

    ``broad`` widens the categories and words; ``limit`` keeps the first tables in type and name order.  Without ``columns``
    the tables hold their own in ``columns``, as metadata documents do; categories then follow the names.
    """
    categories = KEY_CATEGORIES + (["measure", "date"] if broad else ["measure"])
    words = BROAD_WORDS if broad else TYPED_WORDS
    order = [type_rank(F.col("table_type")), "name"] if broad else ["table_type", "name"]
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    if columns is None:
        qualified = lambda x: column_category(x).isin(categories) | contains_any(F.lower(x), words)
        # bound once, so that the list is sifted once; a null name can not qualify
        found = F.filter(F.col("columns.name"), lambda x: F.coalesce(qualified(x), F.lit(False)))
        summary = F.transform(F.array(found), lambda a: F.struct(
            F.array_join(F.sort_array(F.array_distinct(a)), ", ").alias("key_columns"), F.size(a).cast("bigint").alias("key_column_count")))[0]
        if limit is not None:
            # which tables come first is decided by name alone, so only their lists are written out
            some = F.exists(F.col("columns.name"), lambda x: F.coalesce(qualified(x), F.lit(False)))
            tables = tables.filter(some).orderBy(*order).limit(limit)
        joined = tables.withColumn("summary", summary).filter("summary.key_column_count > 0").select("*", "summary.key_columns", "summary.key_column_count")
    else:
        kept = columns.filter(F.col("column_category").isin(categories) | _named_like(words))
        listed = kept.groupBy("table_name").agg(
            F.expr("listagg(DISTINCT name, ', ') WITHIN GROUP (ORDER BY name)").alias("key_columns"), F.count("*").alias("key_column_count")
        )
        joined = listed.join(tables, F.col("table_name") == F.col("name"))
    out = joined.select(
        "name", cut(F.col("description"), description_chars).alias("description"), "table_type", cut(F.col("key_columns"), column_chars).alias("key_columns"), "key_column_count"
    )
    return out.orderBy(*order) if limit is None else out.orderBy(*order).limit(limit)


def type_rank(table_type: Column) -> Column:
    """Place of a type in summaries: fact, dimension, reference, then all others."""
    rank = F.lit(len(TYPE_ORDER) + 1)
    for i, name in reversed(list(enumerate(TYPE_ORDER, 1))):
        rank = F.when(table_type == name, F.lit(i)).otherwise(rank)
    return rank


def schema_summary_sectioned(tables: DataFrame, limit: int = 30, quotas: dict[str, int] | None = None, other_as_fact: bool = True) -> DataFrame:
    """The first tables by type and name, in sections with a quota each.

    Other types join the fact section, or are left out when ``other_as_fact`` is off.  At most
    ``limit`` rows reach the section ranking.
    """
    quotas = quotas or {"fact": 8, "dimension": 8, "reference": 6}
    first = tables.withColumn("type_rank", type_rank(F.col("table_type"))).orderBy("type_rank", "name").limit(limit)
    known = F.col("table_type").isin(TYPE_ORDER)
    section = F.when(known, F.col("table_type")).otherwise(F.lit("fact") if other_as_fact else F.lit("other"))
    placed = top_by(first.withColumn("section", section), ["section"], ["type_rank", "name"], limit, "place")
    within = F.coalesce(*[F.when(F.col("section") == s, F.col("place") <= q) for s, q in quotas.items()], F.lit(False))
    return placed.filter(within).select("section", "place", "name", F.when(F.length("description") > 10, F.substring("description", 1, 60)).alias("about"))


def group_by_type_summary(found: DataFrame, tables: DataFrame) -> DataFrame:
    """Found tables by type with the size of their group and a short description, one row each."""
    short = F.when(F.length("description") > 80, F.concat(F.substring("description", 1, 80), F.lit("..."))).otherwise(F.coalesce("description", F.lit("")))
    typed = found.select("name").distinct().join(tables.select("name", "table_type", "description"), "name", "left").select(
        F.coalesce("table_type", F.lit("unknown")).alias("table_type"), "name", F.coalesce(short, F.lit("")).alias("about")
    )
    return typed.join(typed.groupBy("table_type").agg(F.count("*").alias("tables_of_type")), "table_type")


def catalog_info(tables: DataFrame | None, columns: DataFrame | None, relationship_count: DataFrame | None = None) -> DataFrame:
    """Numbers of tables, columns and relationships and tables per type; a missing part counts zero.

    ``relationship_count`` is a frame with one bigint ``n``.
    """
    spark = next(df for df in (tables, columns, relationship_count) if df is not None).sparkSession

    def counted(label: str, df: DataFrame | None) -> DataFrame:
        n = spark.range(1).select(F.lit(0).cast("bigint").alias("n")) if df is None else df.agg(F.count("*").alias("n"))
        return n.select(F.lit(label).alias("item"), "n")

    out = counted("tables", tables).unionByName(counted("columns", columns))
    edges = counted("relationships", None) if relationship_count is None else relationship_count.select(F.lit("relationships").alias("item"), "n")
    out = out.unionByName(edges)
    if tables is None:
        return out
    return out.unionByName(tables.groupBy("table_type").agg(F.count("*").alias("n")).select(F.concat(F.lit("type "), F.col("table_type")).alias("item"), "n"))
