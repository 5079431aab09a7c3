"""The project's tables in the shapes that the operators take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.session import small, snapshot, table


def _latest(rows: DataFrame, keys: list[str], at: str, number: str) -> DataFrame:
    """The latest row of each key, of the same time the one of the largest number. Only the keys are put side by side, and
    the few rows that give way are taken out; where they are many, or one cannot be told from what stays, whole rows are."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(number).desc())
    older = rows.select(*keys, at, number).withColumns({"rn": F.row_number().over(order), "rk": F.rank().over(order)}).where("rn > 1")
    older = small(older.select("rk", *(F.col(c).alias(f"_{c}") for c in (*keys, at, number))))
    if older.where("rk = 1").isEmpty():
        return rows.join(older, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, at, number))), "left_anti")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per note path: the latest version."""
    return snapshot(spark, sf_dir, "notes", lambda: _latest(table(spark, sf_dir, "notes"), ["path"], "generated_at", "note_id"))


NOTE_FIELDS = {"title": F.col, "tags": F.col}


def note_fields() -> dict:
    return {"title": F.col("title"), "tags": F.array_join("tags", " "), "description": F.col("description"), "headings": T.headings(F.col("body")), "body": F.col("body")}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repository and normal path: the latest scan; ``file`` joins both."""
    return snapshot(spark, sf_dir, "sources", lambda: _sources(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_records").where(F.col("path").isNotNull()).withColumn("path", T.clean_path(F.col("path")))
    rows = _latest(rows, ["repository", "path"], "indexed_at", "record_id")
    return rows.withColumn("file", F.concat("repository", F.lit(":"), "path"))


def source_fields() -> dict:
    return {"path": F.col("path"), "symbols": F.array_join("symbols", " "), "documentation": F.col("documentation"), "body": F.col("text")}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, file, path, symbols, imports): the order tables as a source tree, since the source table has no file that
    uses another: a table's rows are files that import the rows they point to, in the manner of one language each.
    """
    t = lambda name: table(spark, sf_dir, name)

    def files(df: DataFrame, path: str, symbol: str, imported: str | None) -> DataFrame:
        imports = F.expr(f"array({imported})") if imported else F.array().cast("array<string>")
        return df.select(F.lit("shop").alias("scope"), F.expr(path).alias("file"), F.expr(path).alias("path"), F.expr(f"array({symbol})").alias("symbols"), imports.alias("imports"))

    parts = [
        files(t("region"), "concat('lib/geo/regions/r', r_regionkey, '.py')", "r_name", None),
        files(t("nation"), "concat('lib/geo/nations/n', n_nationkey, '.py')", "n_name", "concat('..regions.r', n_regionkey)"),
        files(t("customer"), "concat('crm/customers/c', c_custkey, '.js')", "c_name", "concat('../../lib/geo/nations/n', c_nationkey)"),
        files(t("supplier"), "concat('erp/suppliers/s', s_suppkey, '.java')", "s_name", "concat('geo.nations.n', s_nationkey), 'java.util.List'"),
        files(t("part"), "concat('erp/parts/p', p_partkey, '.c')", "p_brand", None),
        files(t("orders"), "concat('shop/orders/o', o_orderkey, '.py')", "concat('Order#', o_orderkey)", "concat('crm.customers.c', o_custkey), 'os'"),
    ]
    return reduce(DataFrame.unionByName, parts)


def record_calls(spark: SparkSession, sf_dir: str, files: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(scope, file, label, target, at): an order's lines call their supplier and their part's brand by name, a supplier
    and a customer their nation, a nation its region; only those of given files (file) and to given targets (target)."""
    t = lambda name: table(spark, sf_dir, name)
    n, r = t("nation"), t("region")
    lines = t("lineitem").select("l_suppkey", "l_partkey", F.expr("concat('shop/orders/o', l_orderkey, '.py')").alias("file"), F.expr("concat('Order#', l_orderkey, '.line', l_linenumber)").alias("label"), F.col("l_linenumber").cast("long").alias("at"))
    of = lambda df: df if files is None else df.join(files, "file", "left_semi")
    to = lambda df: df if targets is None else df.join(targets, "target", "left_semi")
    suppliers, parts = t("supplier").select("s_suppkey", "s_name"), t("part").select("p_partkey", "p_brand")
    one = F.lit(1).cast("long").alias("at")
    if targets is None:
        sold = of(lines).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
        orders = [sold.select("file", "label", F.explode(F.array("s_name", "p_brand")).alias("target"), "at")]
    else:  # the lines that call no such name are not joined
        orders, columns = [], ("file", "label", "target", "at")
        by_supplier = small(to(suppliers.select("s_suppkey", F.col("s_name").alias("target"))))
        if not by_supplier.isEmpty():
            orders.append(of(lines).join(by_supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select(*columns))
        by_part = small(to(parts.select("p_partkey", F.col("p_brand").alias("target"))))
        if not by_part.isEmpty():
            orders.append(of(lines).join(by_part, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(*columns))
    supplier = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.expr("concat('erp/suppliers/s', s_suppkey, '.java')").alias("file"), F.col("s_name").alias("label"), F.col("n_name").alias("target"), one)
    customer = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.expr("concat('crm/customers/c', c_custkey, '.js')").alias("file"), F.col("c_name").alias("label"), F.col("n_name").alias("target"), one)
    nation = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.expr("concat('lib/geo/nations/n', n_nationkey, '.py')").alias("file"), F.col("n_name").alias("label"), F.col("r_name").alias("target"), one)
    return reduce(DataFrame.unionByName, (*orders, *(to(of(df)).select("file", "label", "target", "at") for df in (supplier, customer, nation)))).withColumn("scope", F.lit("shop"))


def code_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cue_id, text): the stated query set for code, titles of the notes whose id is divisible by 100."""
    return table(spark, sf_dir, "notes").where("note_id % 100 = 0 AND length(title) > 0").select(F.col("note_id").alias("cue_id"), F.col("title").alias("text"))


def note_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cue_id, text): the same for notes, their descriptions and titles."""
    return table(spark, sf_dir, "notes").where("note_id % 100 = 0").select(F.col("note_id").alias("cue_id"), F.concat_ws(" ", "title", "description").alias("text"))
