"""Snapshot diff, classification of changes, impact and blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.operators import graph
from reviewlake.operators.rules import finding

KEYS = ["file_path", "name", "kind"]


def changed_nodes(old: DataFrame, new: DataFrame, with_type_parameters: bool = False) -> DataFrame:
    """new_id, old_id (null: added) of nodes that are new or whose data or line changed.

    Nodes match on path, name and kind; of several old ones the first by id is taken. Deleted nodes are not told.
    """
    fields = ["data", "line"] + ["type_parameters"] * with_type_parameters
    first = old.groupBy(*KEYS).agg(F.min_by(F.struct("id", *fields), "id").alias("o"))
    both = new.select("id", *KEYS, *fields).join(first, KEYS, "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"o.{f}"))
    return both.filter(F.col("o").isNull() | ~same).select(F.col("id").alias("new_id"), F.col("o.id").alias("old_id"))


def compare_signatures(old: Column, new: Column) -> Column:
    """Classification of two function data structs; the first difference in order wins."""
    a, b = old["parameters"], new["parameters"]
    extra = F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(0)))
    optional = F.forall(extra, lambda p: p["default_value"].isNotNull())
    pairs = F.zip_with(
        a, b,
        lambda x, y: F.when(~(x["name"].eqNullSafe(y["name"]) & x["param_type"].eqNullSafe(y["param_type"])), 2)
        .when(x["default_value"].isNull() != y["default_value"].isNull(), 1).otherwise(0),
    )
    first = F.get(F.filter(pairs, lambda c: c > 0), F.lit(0))
    return (
        F.when(~old["return_type"].eqNullSafe(new["return_type"]), "Breaking")
        .when(F.size(b) > F.size(a), F.when(optional, "PotentiallyBreaking").otherwise("Breaking"))
        .when(F.size(b) < F.size(a), "Breaking").when(first == 2, "Breaking").when(first == 1, "PotentiallyBreaking").otherwise("Safe")
    )


def compare_classes(old: Column, new: Column) -> Column:
    removed = (F.size(F.array_except(old["methods"], new["methods"])) > 0) | (F.size(F.array_except(old["fields"], new["fields"])) > 0)
    return F.when(~old["base_classes"].eqNullSafe(new["base_classes"]) | removed, "Breaking").otherwise("Safe")


def classify(changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """changes with classification: Safe, PotentiallyBreaking or Breaking."""
    o = old.select(F.col("id").alias("old_id"), F.col("data").alias("o_data"), F.col("type_parameters").alias("o_types"))
    n = new.select(F.col("id").alias("new_id"), "kind", F.col("data").alias("n_data"), F.col("type_parameters").alias("n_types"))
    both = changes.join(n, "new_id").join(o, "old_id", "left")
    a, b = F.col("o_data"), F.col("n_data")
    told = (
        F.when(F.col("old_id").isNull(), "Safe").when(~F.col("o_types").eqNullSafe(F.col("n_types")), "Breaking")
        .when(F.col("kind") == "Function", compare_signatures(a, b)).when(F.col("kind") == "Class", compare_classes(a, b))
        .when(F.col("kind") == "Type", "Breaking").when((F.col("kind") == "Variable") & b["is_constant"], "Breaking").otherwise("Safe")
    )
    return both.select("new_id", "old_id", told.alias("classification"))


def impact(changes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """changes with direct (callers, as often as they call) and transitive (callers within depth) ids."""
    calls = edges.filter("kind = 'Calls'")
    direct = calls.join(changes.select(F.col("new_id").alias("to_id")), "to_id").groupBy(F.col("to_id").alias("new_id")).agg(F.sort_array(F.collect_list("from_id")).alias("direct"))
    far = graph.closure(calls, changes.select(F.col("new_id").alias("id")), depth)
    far = far.groupBy(F.col("seed").alias("new_id")).agg(F.sort_array(F.collect_set("id")).alias("transitive"))
    none = F.array().cast("array<bigint>")
    return changes.join(direct, "new_id", "left").join(far, "new_id", "left").withColumn("direct", F.coalesce("direct", none)).withColumn("transitive", F.coalesce("transitive", none))


def analyze(old: DataFrame, new: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """new_id, old_id, classification, direct, transitive."""
    return impact(classify(changed_nodes(old, new, with_type_parameters=True), old, new), edges, depth)


def breaking(report: DataFrame) -> DataFrame:
    return report.filter("classification = 'Breaking'")


def potentially_breaking(report: DataFrame) -> DataFrame:
    return report.filter("classification = 'PotentiallyBreaking'")


def summary(report: DataFrame) -> DataFrame:
    """Counts by class; total_affected counts direct callers twice, distinct_affected once."""
    kinds = F.col("classification")
    return report.agg(
        F.count(F.lit(1)).alias("total_changes"), F.count_if(kinds == "Breaking").alias("breaking"), F.count_if(kinds == "PotentiallyBreaking").alias("potentially_breaking"),
        F.count_if(kinds == "Safe").alias("safe"), F.coalesce(F.sum(F.size("direct") + F.size("transitive")), F.lit(0)).cast("long").alias("total_affected"),
    ).join(report.select(F.explode(F.array_union("direct", "transitive")).alias("id")).agg(F.countDistinct("id").alias("distinct_affected")))


def risk(affected: Column, crosses: Column) -> Column:
    high = (affected > 50) | ((affected > 20) & crosses)
    return F.when(high, "HIGH").when((affected > 5) | crosses, "MEDIUM").otherwise("LOW")


def blast_radius(report: DataFrame, nodes: DataFrame) -> DataFrame:
    """directly_modified, affected_dependents, module_crossings, risk: one row. Paths are relative to the root."""
    places = nodes.select("id", T.top_component(F.col("file_path")).alias("module"))
    reached = report.select("new_id", F.explode_outer(F.array_union("direct", "transitive")).alias("id"))
    modules = reached.join(places, "id", "left").withColumnRenamed("module", "theirs").join(places.select(F.col("id").alias("new_id"), F.col("module").alias("own")), "new_id", "left")
    each = modules.groupBy("new_id").agg(F.max(F.coalesce(F.col("theirs") != F.col("own"), F.lit(False))).alias("crosses"))
    total = each.agg(F.count(F.lit(1)).alias("directly_modified"), F.count_if("crosses").alias("module_crossings"))
    both = total.join(reached.agg(F.countDistinct("id").alias("affected_dependents")))
    return both.select("directly_modified", "affected_dependents", "module_crossings", risk(F.col("affected_dependents"), F.col("module_crossings") > 0).alias("risk"))


def impact_findings(report: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """BREAKING and IMPACT findings with callers (path:line of calls, then of transitive callers)."""
    own = nodes.select(F.col("id").alias("new_id"), "kind", "name", "file_path", "line")
    place = nodes.select(F.col("id").alias("from_id"), F.col("file_path").alias("their_path"), F.col("line").alias("their_line"))
    worse = report.filter("classification <> 'Safe'")
    calls = edges.filter("kind = 'Calls'").select("from_id", F.col("to_id").alias("new_id"), F.col("metadata.call_line").alias("call_line"))
    near = worse.select("new_id").join(calls, "new_id").join(place, "from_id").select("new_id", F.lit(0).alias("o"), "from_id", F.concat_ws(":", "their_path", F.coalesce("call_line", "their_line").cast("string")).alias("text"))
    far = worse.select("new_id", F.explode(F.array_except("transitive", "direct")).alias("from_id")).join(place, "from_id")
    far = far.select("new_id", F.lit(1).alias("o"), "from_id", F.concat(F.concat_ws(":", "their_path", F.col("their_line").cast("string")), F.lit(" (transitive)")).alias("text"))
    callers = near.unionByName(far).groupBy("new_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "from_id", "text"))), lambda x: x["text"]).alias("callers"))
    affected = F.size("direct") + F.size("transitive")
    hard = F.col("classification") == "Breaking"
    message = F.format_string("%s `%s` changed, %d dependents affected", F.when(hard, "Breaking change:").otherwise("Potentially breaking change:"), F.col("name"), affected)
    joined = worse.join(own, "new_id").join(callers, "new_id", "left")
    columns = finding(F.when(hard, "BREAKING").otherwise("IMPACT"), F.when(hard, "error").otherwise("warning"), message, F.col("file_path"), F.col("line"), affected=affected)
    return joined.select(*columns, F.coalesce("callers", F.array().cast("array<string>")).alias("callers"))


def unused_exports(nodes: DataFrame, edges: DataFrame, entry_points: tuple[str, ...] = ("main", "new", "default", "init", "__init__", "__main__", "index", "handler", "setup", "teardown")) -> DataFrame:
    """DEAD findings: top-level symbols outside tests that nothing calls or references."""
    kept = nodes.filter(F.col("kind").isin("Function", "Class", "Variable") & ~F.col("name").isin(*entry_points) & ~T.is_test_file_exports(F.col("file_path")))
    dead = graph.without_callers(graph.top_level(nodes, edges).join(kept.select("id"), "id", "left_semi"), edges)
    public = F.col("is_public")
    message = F.when(public, F.format_string("Exported `%s` (%s) has no callers or references", "name", "kind")).otherwise(F.format_string("Private `%s` (%s) is unreachable — no callers in this codebase", "name", "kind"))
    return dead.select(*finding("DEAD", F.when(public, "warning").otherwise("info"), message, F.col("file_path"), F.col("line"), F.lit("Remove this symbol or add a call site to suppress this warning")))


def new_dead_code(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that the old graph lacks and that nothing calls; they need not be top level."""
    kinds = new.filter(F.col("kind").isin("Function", "Class", "Variable") & ~T.is_test_file_exports(F.col("file_path")))
    return graph.without_callers(kinds.join(old.select(*KEYS).distinct(), KEYS, "left_anti"), edges)


def deletion_orphans(old: DataFrame, old_edges: DataFrame, new: DataFrame, new_edges: DataFrame) -> DataFrame:
    """New nodes without callers that a deleted symbol called before; of equal names in a file the first counts."""
    kinds = F.col("kind").isin("Function", "Class", "Variable")
    deleted = old.filter(kinds).join(new.select(*KEYS).distinct(), KEYS, "left_anti").select(F.col("id").alias("from_id"))
    called = old_edges.filter(F.col("kind").isin("Calls", "References")).join(deleted, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    names = old.join(called, "id", "left_semi").select(*KEYS).distinct()
    first = new.filter(kinds).withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("id"))).filter("_n = 1").drop("_n")
    return graph.without_callers(first.join(names, KEYS, "left_semi"), new_edges)
