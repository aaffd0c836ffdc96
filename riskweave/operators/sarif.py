"""SARIF reports: nested documents to a flat findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import let
from ..tables import contexts as values

# A message is an object in most documents and a bare string in some, so it is
# read as text and looked into below.
SARIF_SCHEMA = """
version string,
runs array<struct<
  tool: struct<driver: struct<rules: array<struct<
    id: string, shortDescription: struct<text: string>, properties: map<string,string>>>>>,
  results: array<struct<
    ruleId: string, level: string, message: string,
    properties: map<string,string>, partialFingerprints: map<string,string>,
    locations: array<struct<physicalLocation: struct<
      artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>
"""


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _candidates(properties: Column, rule_properties: Column) -> list[Column]:
    """The result's and the rule's severities in order of precedence, in lower case."""
    return [F.lower(_filled(F.try_element_at(holder, F.lit(key))))
            for holder in (properties, rule_properties) for key in ("security-severity", "severity")]


def _score(name: Column) -> Column:
    # The cast would also take Java's type suffixes, as in 9d.
    return F.when(~name.isin(*values.SEVERITIES) & ~name.rlike("[0-9.][df]$"), F.trim(name).try_cast("double"))


def _named_severity(name: Column, score: Column) -> Column:
    """A severity name as it is, or the band of a score above zero, else NULL."""
    return F.when(name.isNotNull(), F.when(name.isin(*values.SEVERITIES), name).when(F.isnan(score), F.lit(None))
                  .when(score >= 9.0, "critical").when(score >= 7.0, "high")
                  .when(score >= 4.0, "medium").when(score > 0, "low"))


def _add_severity(rows: DataFrame, properties: Column, rule_properties: Column, level: Column) -> DataFrame:
    """Adds ``severity``: the first usable of the result's and the rule's severities, else the level's.
    Names and scores are columns of their own, so that each is worked out once."""
    at = range(4)
    by_level = F.lit(None).cast("string")
    for name, meaning in values.SARIF_LEVELS:
        by_level = F.when(F.lower(level) == name, meaning).otherwise(by_level)
    rows = rows.withColumns({f"_name{i}": name for i, name in enumerate(_candidates(properties, rule_properties))})
    rows = rows.withColumns({f"_score{i}": _score(F.col(f"_name{i}")) for i in at})
    named = [_named_severity(F.col(f"_name{i}"), F.col(f"_score{i}")) for i in at]
    return rows.withColumn("severity", F.coalesce(*named, by_level, F.lit("unknown"))).drop(
        *[f"{part}{i}" for part in ("_name", "_score") for i in at])


_RULES = "id string, shortDescription struct<text: string>, properties map<string,string>"
_RESULTS = ("ruleId string, level string, message string, properties map<string,string>, partialFingerprints map<string,string>, "
            "locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>")


def _objects(items: Column) -> Column:
    return F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _read_one_by_one(document: Column) -> Column:
    """The document with every run, rule and result read by itself: entries that are no objects are passed over, and
    a field of an odd type is NULL, without loss of its neighbours."""
    def each(run: Column, path: str, schema: str) -> Column:
        return F.transform(_objects(F.try_variant_get(run, path, "array<variant>")), lambda x: F.from_json(F.to_json(x), schema))

    def one(run: Column) -> Column:
        rules = each(run, "$.tool.driver.rules", _RULES).alias("rules")
        return F.struct(F.struct(F.struct(rules).alias("driver")).alias("tool"), each(run, "$.results", _RESULTS).alias("results"))

    whole = F.try_parse_json(document)
    return F.struct(F.try_variant_get(whole, "$.version", "string").alias("version"),
                    F.transform(_objects(F.try_variant_get(whole, "$.runs", "array<variant>")), one).alias("runs"))


def parse_sarif(df: DataFrame, *, keys: list[str], json_col: str = "document", max_bytes: int | None = None,
                max_findings: int | None = None) -> DataFrame:
    """``(*keys, sarif, problem)``: parsed documents; ``problem`` tells what is wrong.
    ``runs`` that are no array parse to NULL."""
    df = df.select(*keys, F.col(json_col).alias("_json"), F.octet_length(json_col).alias("_bytes"),
                   F.from_json(F.col(json_col), SARIF_SCHEMA, {"mode": "PERMISSIVE"}).alias("sarif"))
    # One odd entry makes the reader give up a whole list; such documents are read again, entry by entry.
    lost = F.col("sarif.runs").isNull() | F.exists(
        "sarif.runs", lambda run: run.isNull() | run.results.isNull() | run.tool.driver.rules.isNull() | F.exists(run.results, lambda x: x.isNull()))
    df = df.withColumn("sarif", F.when(lost, _read_one_by_one(F.col("_json")).cast(df.schema["sarif"].dataType)).otherwise(F.col("sarif")))
    findings = F.aggregate("sarif.runs", F.lit(0), lambda n, run: n + F.greatest(F.size(run.results), F.lit(0)))
    return df.select(*keys, "sarif", (
        F.when(F.col("_bytes") > (max_bytes or F.lit(None)), "document exceeds the size limit")
        .when((F.coalesce("sarif.version", F.lit("")) != "2.1.0") | F.col("sarif.runs").isNull(),
              "expected a 2.1.0 document with a runs array")
        .when(findings > (max_findings or F.lit(None)), "document has too many findings")).alias("problem"))


def _results_with_rules(run: Column) -> Column:
    """The results of a run, each with the metadata of its rule; of two rules with
    one id the last counts. The ids are taken from the list as a whole, no rule is looked at by itself."""
    rules = run.tool.driver.rules

    def paired(ids):
        def one(result):
            # The id that is looked for is never empty, nor is a rule without one found.
            at = F.array_position(ids, F.coalesce(_filled(result.ruleId), F.lit("unknown")))
            return F.struct(result.alias("result"), let(at, lambda n: F.when(n > 0, F.get(rules, (F.size(ids) - n).cast("int")))).alias("rule"))
        return F.transform(F.filter(run.results, lambda r: r.isNotNull()), one)

    return let(F.reverse(rules.getField("id")), paired)


def normalize_sarif(df: DataFrame, *, keys: list[str], json_col: str = "document", strict: bool = True,
                    max_message: int | None = None, **limits) -> DataFrame:
    """``(*keys, pos, id, title, severity, message, path, line, fingerprint)``.

    Only the rule lookup happens inside the document; results leave it in one
    Generate and are worked out as plain columns. Invalid documents raise;
    ``strict=False`` leaves them out, see `parse_sarif` for the reasons and limits.
    ``max_message`` cuts messages.
    """
    parsed = parse_sarif(df, keys=keys, json_col=json_col, **limits)
    if strict:
        parsed = parsed.withColumn("sarif", F.when(F.col("problem").isNull(), F.col("sarif")).otherwise(
            F.raise_error(F.concat(F.lit("invalid SARIF: "), F.col("problem"))).cast(parsed.schema["sarif"].dataType)))
    else:
        parsed = parsed.filter(F.col("problem").isNull())
    per_run = F.transform(F.filter("sarif.runs", lambda run: run.isNotNull()), _results_with_rules)
    rows = parsed.select(*keys, F.posexplode(F.flatten(F.filter(per_run, lambda f: f.isNotNull()))).alias("pos", "_f"))

    result, rule = F.col("_f.result"), F.col("_f.rule")
    rule_id = F.coalesce(_filled(result.ruleId), F.lit("unknown"))
    is_object = F.ltrim(result.message).startswith("{")
    text = F.when(is_object, F.get_json_object(result.message, "$.text")).otherwise(result.message)
    place = F.get(result.locations, F.lit(0)).physicalLocation
    rows = _add_severity(rows, result.properties, rule.properties, result.level).select(
        *keys, "pos", rule_id.alias("id"), F.coalesce(_filled(rule.shortDescription.text), rule_id).alias("title"), "severity",
        (F.coalesce(text, F.lit("")) if max_message is None else F.left(F.coalesce(text, F.lit("")), F.lit(max_message))).alias("message"),
        _filled(place.artifactLocation.uri).alias("path"), place.region.startLine.alias("line"),
        _filled(F.get(F.map_values(result.partialFingerprints), F.lit(0))).alias("_given"))
    none = F.lit("None")
    material = F.concat_ws("\0", "id", F.coalesce("path", none), F.coalesce(F.col("line").cast("string"), none), "message")
    fingerprint = F.coalesce("_given", F.left(F.sha2(material, 256), F.lit(24)))
    return rows.select(*keys, "pos", "id", "title", "severity", "message", "path", "line", fingerprint.alias("fingerprint"))


def sorted_findings(findings: DataFrame, *, keys: list[str]) -> DataFrame:
    """Findings in report order; a missing path or line sorts first."""
    return findings.orderBy(*keys, F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), "id")


def severity_counts(findings: DataFrame, *, keys: list[str]) -> DataFrame:
    """Findings per key in total and by severity, every severity present."""
    counted = findings.groupBy(*keys).agg(F.count("*").alias("total"), *[
        F.count_if(F.col("severity") == name).alias(name) for name in values.SEVERITIES])
    return counted
