"""Building the catalog network: nodes, relationships, dates, profiles and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kitescope.functions import naming, vectors
from kitescope.session import saved

RELATIONSHIP_COLUMNS = [
    "from_table", "to_table", "from_column", "to_column", "relationship_type", "confidence",
]
NUMERIC_TYPE_NAMES = ["tinyint", "smallint", "int", "bigint", "float", "double", "numeric", "number", "integer"]


def _listed(values: Column, first: int | None = None) -> Column:
    cut = values if first is None else F.slice(values, 1, first)
    return F.coalesce(F.array_join(cut, ", "), F.lit(""))


def table_nodes(metadata: DataFrame, embedding_dims: int | None = None) -> DataFrame:
    """K4: one node per table record, with type and embedding text.

    ``metadata`` has tablename, tableDescription, tableAlias (array) and tableSpecificRules.
    """
    name = F.col("tablename")
    description = F.coalesce(F.col("tableDescription"), F.lit(""))
    rules = F.coalesce(F.col("tableSpecificRules"), F.lit(""))
    nodes = metadata.select(
        naming.stable_id(F.lit("table"), name).alias("id"),
        name.alias("name"),
        description.alias("description"),
        F.col("tableAlias").alias("aliases"),
        rules.alias("rules"),
        naming.table_type(name).alias("table_type"),
        F.concat(
            F.lit("Table: "), name, F.lit(". Description: "), description,
            F.lit(". Aliases: "), _listed(F.col("tableAlias")), F.lit(". Rules: "), rules,
        ).alias("embedding_text"),
    )
    if embedding_dims is None:
        return nodes
    return nodes.withColumn("embedding", vectors.text_embedding(F.col("embedding_text"), embedding_dims))


def column_records(metadata: DataFrame) -> DataFrame:
    """Flatten the nested columns of metadata records; tables without columns give no row."""
    return metadata.select(
        F.col("tablename").alias("table_name"), F.posexplode("columns").alias("pos", "c")
    ).select(
        "table_name",
        (F.col("pos") + 1).alias("ordinal_position"),
        F.col("c.columnname").alias("name"),
        F.coalesce(F.col("c.columnDescription"), F.lit("")).alias("text_description"),
        F.coalesce(F.col("c.columnDescription"), F.col("c.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("c.mapped_col_type"), F.col("c.datatype"), F.lit("unknown")).alias("data_type"),
        F.coalesce(F.col("c.nullable"), F.lit(True)).alias("is_nullable"),
        F.col("c.columnAlias").alias("aliases"),
        F.col("c.distinct_values").alias("distinct_values"),
        F.col("c.provide_distinct").alias("provide_distinct"),
    )


def column_nodes(records: DataFrame, stored_values: int = 50, shown_values: int = 10) -> DataFrame:
    """K5: one node per named column; the first values are stored and fewer are shown in the text."""
    name, table = F.col("name"), F.col("table_name")
    values = F.coalesce(F.col("distinct_values"), F.array().cast("array<string>"))
    return records.filter(F.coalesce(name, F.lit("")) != "").select(
        naming.stable_id(F.lit("column"), table, name).alias("id"),
        "name",
        F.concat_ws(".", table, name).alias("full_name"),
        "table_name",
        "ordinal_position",
        "description",
        "data_type",
        "is_nullable",
        F.slice(values, 1, stored_values).alias("distinct_values"),
        naming.column_category(name).alias("column_category"),
        "provide_distinct",
        F.concat(
            F.lit("Column: "), name, F.lit(" in table "), table,
            F.lit(". Description: "), F.col("text_description"),
            F.lit(". Type: "), F.col("data_type"),
            F.lit(". Aliases: "), _listed(F.col("aliases")),
            F.lit(". Sample values: ["), _listed(values, shown_values), F.lit("]."),
        ).alias("embedding_text"),
    )


def value_nodes(columns: DataFrame, per_column: int = 20) -> DataFrame:
    """K6: nodes for the leading non-blank values of columns worth listing."""
    from kitescope.functions.fixed_values import VALUE_NODE_CATEGORIES

    wanted = (F.coalesce(F.col("provide_distinct"), F.lit("")) == "YES") | F.col("column_category").isin(VALUE_NODE_CATEGORIES)
    exploded = columns.filter(wanted).select(
        "table_name", "full_name", "data_type",
        F.posexplode(F.slice("distinct_values", 1, per_column)).alias("position", "value"),
    )
    is_number = F.col("data_type").isin(NUMERIC_TYPE_NAMES) | F.col("data_type").startswith("decimal")
    return exploded.filter(F.trim(F.coalesce(F.col("value"), F.lit(""))) != "").select(
        naming.stable_id(F.lit("value"), F.col("full_name"), F.col("value")).alias("id"),
        F.col("value").alias("name"),
        F.col("full_name").alias("column_full_name"),
        "table_name",
        (F.col("position") + 1).alias("position"),
        naming.value_type(F.col("value"), is_number).alias("value_type"),
        F.concat(
            F.lit("Value: "), F.col("value"), F.lit(". Column: "), F.col("full_name"),
            F.lit(". Table: "), F.col("table_name"),
        ).alias("embedding_text"),
    )


# --- relationships --------------------------------------------------------------------------------


def key_like_columns(columns: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Distinct (table, column) rows whose name alone supports a relationship (K8 filter first).

    Rows are dealt by name before repeats go: few repeat, so folding them ahead of the shuffle would only fill a task's
    memory, and counts and lists by name need no further shuffle.
    """
    return (
        columns.filter(naming.supports_relationship(F.col("name"), min_confidence))
        .select("table_name", "ord", "name")
        .repartition("name").distinct()
    )


def infer_relationships(columns: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """K7: tables that share an equally named key-like column, as member lists.

    A column name carried by n tables relates n(n-1)/2 pairs, so pairs would grow with the square of the
    catalog.  Every shared name is kept as its list instead: one row per table with the size of the list.
    :func:`relationship_totals` counts the pairs and :func:`relationships_of` expands chosen tables.
    """
    keyed = key_like_columns(columns, min_confidence)
    sized = keyed.withColumn("group_size", F.count("*").over(Window.partitionBy("name"))).filter("group_size > 1")
    return sized.select(
        "table_name", "ord", F.col("name").alias("column_name"), "group_size",
        naming.relationship_type(F.col("name")).alias("relationship_type"),
        naming.relationship_confidence(F.col("name")).alias("confidence"),
    )


def relationship_totals(columns: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Exact number of inferred relationships per type, without writing out any pair."""
    keyed = key_like_columns(columns, min_confidence)
    sizes = keyed.groupBy("name").agg(F.count("*").alias("n"))
    return sizes.groupBy(naming.relationship_type(F.col("name")).alias("relationship_type")).agg(
        F.sum(F.expr("n * (n - 1) DIV 2")).alias("n_relationships")
    )


def relationships_of(columns: DataFrame, chosen: DataFrame, per_table: int = 5) -> DataFrame:
    """First ``per_table`` related tables (by name) of each chosen table, hot names included.

    Only the leading members of each name are needed: a related table among the first n overall is
    among the first n + 1 of the name that relates it (one of which may be the table itself).  Ranks count each table once, so
    tasks cut their rows to the leading ones ahead of the shuffle.  Chosen tables that hold the ``names`` of their columns
    need no join with all columns.
    """
    keyed = columns.filter(naming.supports_relationship(F.col("name"), 0.7) & F.col("table_name").isNotNull()).select("table_name", "name")
    first = Window.partitionBy("name").orderBy("table_name")
    leading = keyed.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= per_table + 1).select("name", F.col("table_name").alias("related"))
    if "names" in chosen.columns:
        own = chosen.select(F.col("table_name").alias("seed"), F.explode("names").alias("name")).filter(naming.supports_relationship(F.col("name"), 0.7))
    else:
        own = keyed.join(chosen.select("table_name").distinct(), "table_name", "left_semi").select(F.col("table_name").alias("seed"), "name")
    near = own.join(leading, "name").filter(F.col("seed") != F.col("related")).select("seed", "related")
    place = Window.partitionBy("seed").orderBy("related")
    return near.withColumn("rank", F.dense_rank().over(place)).filter(F.col("rank") <= per_table).distinct()


def domain_rule_relationships(rules: DataFrame, tables: DataFrame) -> DataFrame:
    """K9: rule edges whose two tables both exist."""
    names = tables.select("name").distinct()
    return (
        rules.join(names.withColumnRenamed("name", "from_table"), "from_table", "left_semi")
        .join(names.withColumnRenamed("name", "to_table"), "to_table", "left_semi")
        .select(*RELATIONSHIP_COLUMNS)
    )


def merged_explicit_edges(explicit: list[DataFrame], members: DataFrame) -> DataFrame:
    """The edge rows of :func:`merge_relationships`: the winner of every key and what it replaces.

    A digest leads the keys, so sorting rarely has to read the texts behind it; folding and the first look into the lists
    share one deal and one order.  What the first look found is written, so that its shuffle files go before the second.
    """
    kind = F.struct("priority", "turned", "relationship_type", "confidence")
    ranked = [
        df.select(
            F.least("from_table", "to_table").alias("a"), F.greatest("from_table", "to_table").alias("b"),
            F.col("from_column").alias("ca"), F.col("to_column").alias("cb"),
            F.lit(i).alias("priority"), (F.col("from_table") > F.col("to_table")).alias("turned"), "relationship_type", "confidence",
        ) for i, df in enumerate(explicit)]
    keyed = reduce(DataFrame.unionByName, ranked).withColumn("ha", F.xxhash64("a", "ca"))
    best = keyed.repartition("ha", "a", "ca").groupBy("ha", "a", "ca", "b", "cb").agg(F.min(kind).alias("r"))
    # an inferred edge has one name on both sides and both tables in the name's list
    listed = members.select(F.xxhash64("table_name", "column_name").alias("h"), "table_name", "column_name", "relationship_type")
    first = listed.select(F.col("h").alias("ha"), F.col("table_name").alias("a"), F.col("column_name").alias("ca"), F.col("relationship_type").alias("kind"))
    second = listed.select(F.col("h").alias("hb"), F.col("table_name").alias("b"), F.col("column_name").alias("cb"), F.lit(True).alias("there"))
    met = saved(best.join(first.hint("merge"), ["ha", "a", "ca"], "left").drop("ha"), "looked-up")
    inner = (F.col("ca") == F.col("cb")) & (F.col("a") != F.col("b")) & F.col("kind").isNotNull()
    met = met.withColumn("hb", F.when(inner, F.xxhash64("b", "cb"))).join(second.hint("merge"), ["hb", "b", "cb"], "left")
    turned = F.col("r.turned")
    return met.select(
        F.lit("edge").alias("form"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("from_table"),
        F.when(turned, F.col("a")).otherwise(F.col("b")).alias("to_table"), F.col("ca").alias("from_column"), F.col("cb").alias("to_column"),
        "r.relationship_type", "r.confidence", F.lit(None).cast("bigint").alias("group_size"),
        F.when(F.col("there"), F.col("kind")).alias("replaces"))


def member_rows(members: DataFrame) -> DataFrame:
    """The lists of :func:`merge_relationships`."""
    return members.select(
        F.lit("member").alias("form"), F.col("table_name").alias("from_table"), F.lit(None).cast("string").alias("to_table"),
        F.col("column_name").alias("from_column"), F.col("column_name").alias("to_column"), "relationship_type", "confidence",
        "group_size", F.lit(None).cast("string").alias("replaces"))


def merge_relationships(explicit: list[DataFrame], members: DataFrame) -> DataFrame:
    """One edge per (unordered table pair, columns), as inferred lists plus explicit edges.

    ``explicit`` holds edges in order of precedence (curated ones, then rules); each wins over the inferred edge
    with its key.  Rows have ``form`` 'member' (a table of a list of inferred edges) or 'edge'; an edge that stands
    for an inferred one says in ``replaces`` of which type that was.
    """
    return merged_explicit_edges(explicit, members).unionByName(member_rows(members))


def merged_totals(merged: DataFrame) -> DataFrame:
    """Exact number of merged edges per type."""
    lists = merged.filter("form = 'member'").groupBy("from_column", "relationship_type").agg(F.max("group_size").alias("n"))
    inferred = lists.select("relationship_type", F.expr("n * (n - 1) DIV 2").alias("n"))
    edges = merged.filter("form = 'edge'")
    gained = edges.select("relationship_type", F.lit(1).cast("bigint").alias("n"))
    lost = edges.filter("replaces IS NOT NULL").select(F.col("replaces").alias("relationship_type"), F.lit(-1).cast("bigint").alias("n"))
    return inferred.unionByName(gained).unionByName(lost).groupBy("relationship_type").agg(F.sum("n").alias("n")).filter("n > 0")


def merged_edges_of(merged: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every merged edge of the chosen tables: (seed, related, from_column, to_column, relationship_type)."""
    seeds = chosen.select(F.col("table_name").alias("seed")).distinct()
    lists, edges = merged.filter("form = 'member'"), merged.filter("form = 'edge'")
    mine = lists.join(seeds, F.col("from_table") == F.col("seed")).select("seed", "from_column", "relationship_type")
    inferred = mine.join(lists.select("from_column", F.col("from_table").alias("related")), "from_column").filter("seed != related")
    inferred = inferred.select(
        F.least("seed", "related").alias("a"), F.greatest("seed", "related").alias("b"), F.col("from_column").alias("ca"), "seed", "related", "relationship_type")
    gone = edges.filter("replaces IS NOT NULL").select(
        F.least("from_table", "to_table").alias("a"), F.greatest("from_table", "to_table").alias("b"), F.col("from_column").alias("ca"))
    left = inferred.join(gone, ["a", "b", "ca"], "left_anti").select(
        "seed", "related", F.col("ca").alias("from_column"), F.col("ca").alias("to_column"), "relationship_type")
    there = edges.select(F.col("from_table").alias("seed"), F.col("to_table").alias("related"), "from_column", "to_column", "relationship_type")
    back = edges.filter("from_table != to_table").select(
        F.col("to_table").alias("seed"), F.col("from_table").alias("related"), "from_column", "to_column", "relationship_type")
    return left.unionByName(there.unionByName(back).join(seeds, "seed", "left_semi").select(*left.columns))


def merged_counts_of(merged: DataFrame, chosen: DataFrame) -> DataFrame:
    """(seed, relationship_type, n): how many merged edges the chosen tables have, counted without writing them out.

    A member of a list of n has n - 1 inferred edges; replaced ones go, explicit ones come.
    """
    seeds = chosen.select(F.col("table_name").alias("seed")).distinct()
    lists, edges = merged.filter("form = 'member'"), merged.filter("form = 'edge'")
    inferred = lists.select(F.col("from_table").alias("seed"), "relationship_type", (F.col("group_size") - 1).alias("n"))
    pairs = edges.filter("replaces IS NOT NULL").select(
        F.least("from_table", "to_table").alias("a"), F.greatest("from_table", "to_table").alias("b"), "replaces")
    lost = pairs.select(F.explode(F.array("a", "b")).alias("seed"), F.col("replaces").alias("relationship_type"), F.lit(-1).cast("bigint").alias("n"))
    # an edge between two tables counts for both, a table's edge with itself once
    ends = F.explode(F.array_distinct(F.array("from_table", "to_table"))).alias("seed")
    gained = edges.select(ends, "relationship_type", F.lit(1).cast("bigint").alias("n"))
    every = inferred.unionByName(lost).unionByName(gained).join(seeds, "seed", "left_semi")
    return every.groupBy("seed", "relationship_type").agg(F.sum("n").alias("n")).filter("n > 0")


# --- dates, statistics, checks ----------------------------------------------------------------------


def date_nodes(values: DataFrame, column: str = "date_string", limit: int | None = None) -> DataFrame:
    """Calendar nodes from YYYYMMDD strings; other shapes and impossible dates are skipped.

    ``limit`` keeps only the first values, for catalogs that list a sample.
    """
    source = values.select(F.col(column).alias("date_string"))
    if limit is not None:
        source = source.orderBy("date_string").limit(limit)
    parsed = source.filter(F.col("date_string").rlike("^[0-9]{8}$")).withColumn(
        "date_value", F.try_to_date("date_string", "yyyyMMdd")
    )
    day = F.col("date_value")
    return parsed.filter(day.isNotNull()).select(
        naming.stable_id(F.lit("date"), F.col("date_string")).alias("id"),
        "date_value", "date_string",
        F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"),
        F.weekday(day).alias("day_of_week"), (F.weekday(day) < 5).alias("is_business_day"),
    )


def embedding_stats(metadata: DataFrame) -> DataFrame:
    """How many embedded rows per provider, dimension count and model."""
    return metadata.groupBy("provider", "dimensions", "model_version").agg(F.count("*").alias("n"))


def verify_network(tables: DataFrame, columns: DataFrame, counted: dict[str, DataFrame], edge_types: DataFrame, top: int = 5) -> DataFrame:
    """Counts per node table, type distributions and the widest tables, as (section, item, n).

    ``edge_types`` is (relationship_type, n) so that hub relationships count without being expanded.
    """
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("section"), F.lit(label).alias("item"), "n")
        for label, df in counted.items()
    ]
    parts.append(
        tables.groupBy("table_type").agg(F.count("*").alias("n")).select(F.lit("table_type").alias("section"), F.col("table_type").alias("item"), "n")
    )
    parts.append(edge_types.select(F.lit("relationship_type").alias("section"), F.col("relationship_type").alias("item"), "n"))
    per_table = columns.groupBy("table_name").agg(F.count("*").alias("n"))
    widest = (
        tables.select("name").join(per_table, F.col("name") == F.col("table_name"), "left")
        .select("name", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy(F.desc("n"), "name").limit(top)
    )
    parts.append(widest.select(F.lit("widest").alias("section"), F.col("name").alias("item"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- profiling ---------------------------------------------------------------------------------------


def _as_text(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """(column_name, value, n) over all scalar columns, one pass; hot values fold before the shuffle."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    text = df.select(*[_as_text(f).alias(f.name) for f in fields])
    long = text.unpivot([], [f.name for f in fields], "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def profile_columns(df: DataFrame, table_name: str, sample_values: int = 50) -> DataFrame:
    """Rows, nulls, exact distinct count, extremes and the first distinct values per column."""
    counts = value_counts(df)
    value = F.col("value")
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    # texts tell values apart and show them; numbers are compared as numbers, equal doubles (huge whole numbers) by text
    order = F.struct(F.when(F.col("column_name").isin(numeric), value.try_cast("double")).alias("number"), value.alias("text"))
    some = F.when(value.isNotNull(), order)
    summary = counts.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count(value).alias("n_distinct"),
        F.min(some)["text"].alias("min_value"),
        F.max(some)["text"].alias("max_value"),
    )
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(order))
    leading = (
        counts.filter(value.isNotNull()).withColumn("place", place).filter(F.col("place") <= sample_values)
        .groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("distinct_values"))
    )
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return summary.join(leading, "column_name", "left").select(
        F.lit(table_name).alias("table_name"), "column_name",
        kinds[F.col("column_name")].alias("data_type"),
        "n_rows", "n_nulls", "n_distinct", "min_value", "max_value", "distinct_values",
    )


def profile_as_records(profile: DataFrame) -> DataFrame:
    """Profiles in the shape of :func:`column_records`, so measured columns feed K5 and K6."""
    return profile.select(
        "table_name", F.lit(0).alias("ordinal_position"), F.col("column_name").alias("name"),
        F.lit("").alias("text_description"), F.lit("").alias("description"), "data_type",
        (F.col("n_nulls") > 0).alias("is_nullable"), F.array().cast("array<string>").alias("aliases"),
        "distinct_values", F.when(F.col("n_distinct") <= 50, F.lit("YES")).alias("provide_distinct"),
    )
