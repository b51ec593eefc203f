"""Project configurations: landed JSON to a table with defaults, and rejects that name the fields at fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

TEXT, TEXTS, WHOLE, FLAG = "string", "array<string>", "bigint", "boolean"
TYPES = {TEXT: ("STRING",), TEXTS: ("ARRAY<STRING>", "ARRAY<VOID>"), WHOLE: ("BIGINT",), FLAG: ("BOOLEAN",)}

# Names, kinds and defaults of the fields; a default of None means that the field has none.
FIELDS = {
    "domain": ("domain", TEXT, None),
    "brand_name": ("brandName", TEXT, None),
    "brand_tokens": ("brandTokens", TEXTS, None),
    "seed_competitors": ("seedCompetitors", TEXTS, []),
    "seed_keywords": ("seedKeywords", TEXTS, None),
    "ai_queries": ("aiQueries", TEXTS, []),
    "audit_urls": ("auditUrls", TEXTS, []),
    "locale": ("locale", TEXT, "tr-TR"),
    "mock_seed": ("mockSeed", WHOLE, 42),
    "crawl_max_pages": ("crawlMaxPages", WHOLE, 300),
    "crawl_max_depth": ("crawlMaxDepth", WHOLE, 5),
    "crawl_exclude_paths": ("crawlExcludePaths", TEXTS, []),
    "crawl_enabled": ("crawlEnabled", FLAG, True),
    "code_path": ("codePath", TEXT, None),
}
REQUIRED = ("domain", "brand_name", "brand_tokens", "seed_keywords")
POSITIVE = ("crawl_max_pages", "crawl_max_depth")
MAY_BE_EMPTY = ("locale",)


def _fault(name: str) -> Column:
    """The field is absent though required, of another type, null, empty, not positive, or no URL."""
    key, kind, _ = FIELDS[name]
    found = F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant"))
    value = F.try_variant_get("v", f"$.{key}", kind)
    bad = ~found.isin(*TYPES[kind])
    if kind == TEXTS:
        fit = (lambda x: F.try_parse_url(x, F.lit("PROTOCOL")).isNotNull()) if name == "audit_urls" else (lambda x: F.length(x) > 0)
        bad = bad | ~F.forall(value, lambda x: F.coalesce(fit(x), F.lit(False)))
        bad = bad | (F.size(value) == 0) if name in REQUIRED else bad
    elif kind == TEXT and name not in MAY_BE_EMPTY:
        bad = bad | (value == "")
    elif name in POSITIVE:
        bad = bad | (value <= 0)
    return F.when(found.isNull(), name in REQUIRED).otherwise(F.coalesce(bad, F.lit(True)))


def read(landed: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """landed with a JSON ``payload`` -> (its other columns and the fields with their defaults, rejects with ``errors``).

    A payload that is null, no JSON or no object has the one error ``json``; other errors are the names of fields in order.
    Fields that are not known are passed over. The payloads are parsed and judged once, in all cores, and written for both results.
    """
    # a generator is computed once a row; a plain column would be parsed again in every expression that names it
    once = lambda df, name, c: df.select("*", F.explode(F.array(c)).alias(name))
    rows = once(landed.repartition(landed.sparkSession.sparkContext.defaultParallelism), "v", F.try_parse_json(payload))
    whole = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    errors = F.array_compact(F.array(*(F.when(_fault(name), FIELDS[name][0]) for name in FIELDS)))
    rows = once(rows, "errors", F.when(F.coalesce(whole, F.lit(False)), errors).otherwise(F.array(F.lit("json"))))
    made = []
    for name, (key, kind, default) in FIELDS.items():
        value = F.try_variant_get("v", f"$.{key}", kind)
        value = value if default is None else F.coalesce(value, F.array().cast(kind) if default == [] else F.lit(default).cast(kind))
        made.append(value.alias(name))
    rows = stored(rows.select(*landed.columns, "errors", F.struct(*made).alias("_fields")), "configs")
    others = [c for c in landed.columns if c != payload and c not in FIELDS]
    good = rows.where(F.size("errors") == 0).select(*others, "_fields.*")
    return good, rows.where(F.size("errors") > 0).select(*landed.columns, "errors")
