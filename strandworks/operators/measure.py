"""Measurement tables: gates, masks, normalisers to one observation schema, labels by molecule, exposure, exports.

Fixed values: the names of reasons and states that these functions return, which readers of their tables expect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import censor, text


def reasons(rules: dict[str, Column]) -> Column:
    """array of the names of all rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def design_valid(sequence_ok: Column, length: Column, design: Column) -> Column:
    """A generated sequence is valid if it is well formed and as long as was asked for."""
    return F.coalesce(sequence_ok & (length == design), F.lit(False))


def chemistry(n_end: Column, c_end: Column, bonds: Column, known: Column) -> Column:
    """reported_linear_free, modified, or unknown where nothing is reported."""
    said = F.coalesce(known, F.lit(False))
    return F.when(~said, "unknown").when(text_present(n_end) | text_present(c_end) | text_present(bonds), "modified").otherwise("reported_linear_free")


def text_present(c: Column) -> Column:
    return F.coalesce(censor.to_null(c).isNotNull(), F.lit(False))


def usable(canonical: Column, form: Column, measured: Column, consensus: Column) -> Column:
    """A canonical sequence of known free form with a measured or a consensus value."""
    return F.coalesce(canonical & (form == "reported_linear_free") & (measured.isNotNull() | consensus.isNotNull()), F.lit(False))


def training_masks(exact: Column, label: Column, lower: Column, upper: Column, form: Column, level: Column) -> dict[str, Column]:
    """Which rows a loss can use: exact values, sure labels, any bound; with strict chemistry; of strains only."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    strict = yes(form == "reported_linear_free")
    masks = {"exact": yes(exact), "classification": label.isNotNull(), "interval": lower.isNotNull() | upper.isNotNull()}
    return masks | {f"{k}_strict": m & strict for k, m in masks.items()} | {"strain_exact": masks["exact"] & yes(level == "strain")}


def fold_masks(df: DataFrame, fold: str, group: str, held: int) -> DataFrame:
    """Add training and validation of one held fold; a group that stands in several folds is an error when read."""
    w = W.partitionBy(group)
    leak = F.min(fold).over(w) != F.max(fold).over(w)
    guard = F.when(leak, F.raise_error(F.concat(F.lit("a group in several folds: "), F.col(group).cast("string"))).cast("boolean"))
    return df.withColumn("training", F.coalesce(guard, F.col(fold) != held)).withColumn("validation", F.col(fold) == held)


def regime_masks(df: DataFrame, regime: str, peptide_fold: int | None, genome_fold: int | None) -> DataFrame:
    """Add training and validation when peptides, strains or both are held out; strain folds count only for exactly labelled genomes.

    Rows: peptide_fold, genome_fold, primary, genome_status.
    """
    train, held = F.lit(True), F.col("primary")
    if regime in ("peptide", "both"):
        train, held = train & (F.col("peptide_fold") != peptide_fold), held & (F.col("peptide_fold") == peptide_fold)
    if regime in ("strain", "both"):
        known = (F.col("genome_status") == "exact_label") & (F.col("genome_fold") >= 0)
        train, held = train & known & (F.col("genome_fold") != genome_fold), held & known & (F.col("genome_fold") == genome_fold)
    return df.withColumn("training", F.coalesce(train, F.lit(False))).withColumn("validation", F.coalesce(held, F.lit(False)))


#: The most names that are sent to all tasks; a longer table is joined by a shuffle.
FEW = 100_000


def canonical_names(df: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
    """Add the canonical name by a table (alias, canonical); null for names that are in none.

    A table of at most ``FEW`` names, which is counted, goes to the rows: a shuffle by name would put all rows of
    a common name in one task.
    """
    a = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias(out))
    if a.limit(FEW + 1).count() <= FEW:
        a = F.broadcast(a)
    return df.join(a, F.col(name) == F.col("_alias"), "left").drop("_alias")


def without_shared(right: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """The right table without columns that the left one has, but for the keys."""
    return right.drop(*[c for c in right.columns if c in left.columns and c not in keys])


def null_if_any_missing(df: DataFrame, metric: str, group: list[str]) -> DataFrame:
    """The metric, null for a whole group if any of its rows lacks it."""
    return df.withColumn(metric, F.when(F.count_if(F.col(metric).isNull()).over(W.partitionBy(*group)) == 0, F.col(metric)))


def if_covered(value: Column, coverage: Column, full: float = 100.0) -> Column:
    return F.when(coverage == full, value)


def from_consensus(df: DataFrame) -> DataFrame:
    """Rows (id, sequence, targets: map of name to array of numbers) -> one observation a target: the third number is a consensus, never a measurement."""
    long = df.select("id", "sequence", F.explode("targets").alias("target", "values"))
    third = F.get("values", F.lit(2))
    good = (third > 0) & (third < float("inf")) & ~F.isnan(third)
    return long.select(
        F.concat_ws(":", F.lit("consensus"), F.col("id").cast("string"), "target").alias("observation_id"), "sequence", "target", F.col("target").alias("species"), F.lit("species").alias("target_level"),
        F.when(good, third).alias("consensus_um"), F.lit(None).cast("double").alias("value_um"), F.array(F.lit("consensus_not_raw_measurement")).alias("exclusion_reasons"),
    )


def from_measured(df: DataFrame, mass: Column, aliases: DataFrame) -> DataFrame:
    """Rows (id, sequence, target, concentration, unit, form, form_conflict) -> observations: value in micromoles, label and all reasons against them.

    Mass units are converted only for free linear chains, by their mass. aliases: (alias, canonical) of targets.
    """
    p = censor.parse(F.col("concentration"))
    u = text.unit(F.col("unit"))
    free = F.col("form") == "reported_linear_free"
    rows = df.withColumn("form", F.when(F.col("form_conflict"), "conflicting_metadata").otherwise(F.col("form"))).withColumn("_p", p)
    rows = canonical_names(rows.withColumn("target", text.spaces(F.col("target"))), "target", aliases, "pathogen")
    value = F.when(u == "um", F.col("_p.value")).when((u == "ug/ml") & free, text.micromolar(F.col("_p.value"), F.col("unit"), mass))
    why = reasons({
        "invalid_or_ambiguous_concentration": F.col("_p").isNull(), "unverified_chemical_form_for_mass_conversion": F.col("_p").isNotNull() & (u == "ug/ml") & ~free,
        "unsupported_or_missing_unit": F.col("_p").isNotNull() & ~F.coalesce(u.isin("um", "ug/ml"), F.lit(False)), "chemical_form": ~F.coalesce(free, F.lit(False)),
        "outside_length": ~F.length("sequence").between(8, 50), "no_exact_target_match": F.col("pathogen").isNull(),
    })
    out = rows.withColumn("value_um", value).withColumn("relation", F.col("_p.relation")).withColumn("exclusion_reasons", why).withColumn("species", text.species(F.col("target")))
    return out.withColumn("active", censor.label(F.col("relation"), F.col("value_um"))).withColumn("eligible", F.size("exclusion_reasons") == 0).drop("_p")


def to_bounds(df: DataFrame, value: str, relation: str) -> DataFrame:
    """Add lower_log2 and upper_log2: null where there is no bound; a bound that isn't positive is an error when read."""
    b = censor.bounds(F.col(relation), F.when(~F.isnan(F.col(value)), F.col(value)))
    bad = F.when((b["lo"] <= 0) | (b["hi"] <= 0) | (b["lo"] > b["hi"]), F.raise_error(F.lit("bounds must be positive and in order")).cast("double"))
    return df.withColumn("lower_log2", F.coalesce(bad, F.log2(b["lo"]))).withColumn("upper_log2", F.coalesce(bad, F.log2(b["hi"])))


def percent_endpoint(df: DataFrame) -> DataFrame:
    """Rows (value, relation, percent, species) of lysis -> the rows with endpoint and reject: a measured half concentration, a percentage, or why not."""
    half = F.col("percent") == 50
    reject = F.when(F.col("value").isNull(), "no_value").when(F.col("percent").isNull(), "no_percentage").when(~F.col("percent").between(0, 100), "percentage_out_of_range").when(F.col("species").isNull(), "no_species")
    return df.withColumn("reject", reject).withColumn("endpoint", F.when(reject.isNull(), F.when(half, "measured_half").otherwise("percentage")))


def molecule_labels(df: DataFrame, molecule: list[str], species: str, value: str, relation: str, assay: list[str], threshold: float = 16.0) -> DataFrame:
    """(molecule_id, species, hit_lower, hit_upper, assays, targets): sure and possible hits over a molecule's distinct assays."""
    b = censor.bounds(F.col(relation), F.col(value))
    sure, may = F.coalesce(b["hi"] <= threshold, F.lit(False)), b["lo"].isNull() | (b["lo"] < threshold) | ((b["lo"] == threshold) & b["lo_closed"])
    rows = df.where(F.col(value).isNotNull() & F.col(relation).isNotNull()).withColumn("molecule_id", text.json_key(*molecule)).withColumn("_a", text.json_key(*assay, value, relation, species))
    rows = rows.select("molecule_id", species, "_a", "target", sure.cast("int").alias("lo"), may.cast("int").alias("hi")).groupBy("molecule_id", species, "_a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("target").alias("target"))
    return rows.groupBy("molecule_id", species).agg(F.min("lo").alias("hit_lower"), F.max("hi").alias("hit_upper"), F.count("*").alias("assays"), F.to_json(F.array_sort(F.collect_set("target"))).alias("targets"))


def joint_bounds(mic: Column, hc: Column, ratio: float = 8.0, threshold: float = 16.0) -> Column:
    """struct<certain, possible>: a value at most the threshold and another at least ratio times it; both are censor.bounds structs."""
    certain = F.coalesce((mic["hi"] <= threshold) & (hc["lo"] >= ratio * mic["hi"]), F.lit(False))
    low = F.coalesce(mic["lo"], F.lit(0.0))
    shut = F.coalesce(mic["lo_closed"] & mic["lo"].isNotNull(), F.lit(False))
    may = (low < threshold) | ((low == threshold) & shut)
    wide = hc["hi"].isNull() | (hc["hi"] > ratio * low) | ((hc["hi"] == ratio * low) & hc["hi_closed"] & shut)
    return F.struct(certain.cast("int").alias("certain"), (may & wide).cast("int").alias("possible"))


def exposure_of(df: DataFrame, key: str, used: DataFrame, certified: DataFrame) -> DataFrame:
    """Add exposure: used if the key is in ``used``, certified_unused if in ``certified``, else unknown."""
    u, c = used.select(F.col(key).alias("_u")).distinct(), certified.select(F.col(key).alias("_c")).distinct()
    out = df.join(u, F.col(key) == F.col("_u"), "left").join(c, F.col(key) == F.col("_c"), "left")
    return out.withColumn("exposure", F.when(F.col("_u").isNotNull(), "used").when(F.col("_c").isNotNull(), "certified_unused").otherwise("unknown")).drop("_u", "_c")


def isolated_exports(df: DataFrame, part: str, key: str, inputs: list[str], labels: list[str]) -> dict[str, DataFrame]:
    """Disjoint tables: training rows whole, held-out inputs without labels, and their labels by key."""
    held = df.where(F.col(part) == "holdout")
    return {"training": df.where(F.col(part) == "train").select(key, *inputs, *labels), "inference": held.select(key, *inputs), "scoring": held.select(key, *labels)}


def lineage(export: DataFrame, assays: DataFrame, on: list[str], assay_id: str) -> DataFrame:
    """Exported rows with the one assay they match, and the status of rows that share an export key."""
    from . import graph, joins

    matched = joins.unique_match(export, assays, on, assay_id)
    return graph.duplicate_links(matched, on, "match")


def apply_evidence(df: DataFrame, evidence: DataFrame, key: str, row_hash: str, columns: list[str]) -> DataFrame:
    """The rows with the evidence's columns where key and row hash both match; evidence for another version of a row is left out."""
    e = evidence.select(F.col(key).alias("_k"), F.col(row_hash).alias("_h"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(e, (F.col(key) == F.col("_k")) & (F.col(row_hash) == F.col("_h")), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns], F.col("_k").isNotNull().alias("applied"))


def observation_issues(df: DataFrame) -> DataFrame:
    """(observation_id, reason): all broken rules of observations (observation_id, relation, value_um, lower, upper, active, percent)."""
    inf = float("inf")
    rules = {
        "relation_without_value": F.col("relation").isNotNull() & F.col("value_um").isNull(), "value_without_relation": F.col("value_um").isNotNull() & F.col("relation").isNull(), "unknown_relation": ~F.col("relation").isin("=", "<", "<=", ">", ">="),
        "value_not_positive": ~((F.col("value_um") > 0) & (F.col("value_um") < inf)), "inverted_bounds": F.col("lower") > F.col("upper"), "exact_with_open_bounds": (F.col("relation") == "=") & ~F.col("lower").eqNullSafe(F.col("upper")),
        "label_disagrees": F.col("active").isNotNull() & ~F.col("active").eqNullSafe(censor.label(F.col("relation"), F.col("value_um"))), "percent_out_of_range": ~F.col("percent").between(0, 100),
    }
    return df.select("observation_id", F.explode(reasons(rules)).alias("reason"))


def grid_values(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """Registered cells (file, tbl, row, col, cell_text, value) beside what the grid (file, tbl, row, col, text) says: ok, changed text, changed value or missing."""
    g = grid.select("file", "tbl", "row", "col", text.spaces(F.col("text")).alias("_t"))
    out = cells.join(g, ["file", "tbl", "row", "col"], "left")
    same_text, again = F.col("_t") == text.spaces(F.col("cell_text")), censor.parse(F.col("_t"))["value"]
    return out.withColumn("replay", F.when(F.col("_t").isNull(), "missing").when(~same_text, "changed_text").when(~again.eqNullSafe(F.col("value")), "changed_value").otherwise("ok")).drop("_t")


def prediction_rows(df: DataFrame, key: str, targets: list[str], fallback: str) -> DataFrame:
    """Wide predictions (a column a target, and one of the fallback's for each: <target>_<fallback>) -> (key, target, prediction, supported, fallback_reason)."""
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("p"), F.col(f"{t}_{fallback}").cast("double").alias("f")) for t in targets])
    ok = F.col("x.p").isNotNull() & ~F.isnan("x.p")
    return df.select(key, F.explode(cells).alias("x")).select(key, "x.target", F.when(ok, F.col("x.p")).otherwise(F.col("x.f")).alias("prediction"), ok.alias("supported"), F.when(ok, "").otherwise("no_supported_head").alias("fallback_reason"))


def blend_targets(new: DataFrame, base: DataFrame, key: str, weight: float) -> DataFrame:
    """(key, target, prediction): weight x base + (1 - weight) x new over equal (key, target); a pair that one lacks is an error when read."""
    n, b = new.select(key, "target", F.col("prediction").alias("_n")), base.select(key, "target", F.col("prediction").alias("_b"))
    both = n.join(b, [key, "target"], "full")
    whole = F.when(F.col("_n").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("incomplete prediction coverage")).cast("double"))
    return both.select(key, "target", F.coalesce(whole, weight * F.col("_b") + (1 - weight) * F.col("_n")).alias("prediction"))
