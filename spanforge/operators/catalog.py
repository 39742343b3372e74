"""Catalogs of types, pipelines, presets and models: merged, edited and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators.detect import Rule

SCHEMA = "id string, name string, category string, risk_level int, `order` int, enabled boolean, use_llm boolean, regex_pattern string, tag_template string"
PIPELINES = "mode string, enabled boolean, types array<struct<id:string,name:string,order:int,enabled:boolean>>"
CUSTOM_ORDER = 200


def preset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.CATALOG, SCHEMA)


def merged(base: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    """Stored rows replace those of their id; the rest of both stays."""
    return base.join(stored.select(id_col), id_col, "left_anti").unionByName(stored, allowMissingColumns=True)


def listed(catalog: DataFrame, *, enabled_only: bool = False) -> DataFrame:
    return (catalog.where("enabled") if enabled_only else catalog).orderBy("order", "id")


def natural_key(name: Column, width: int = 40) -> Column:
    """The name with its numbers filled up by zeros, so that ``a 9`` stands before ``a 10`` wherever digits sort by their value."""
    parts = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(bare(p)))), bare(p))).otherwise(p)), "")


def recognition_columns(locale: str = "zh_CI_AI") -> list[Column]:
    """The order of types on the screen: those with a pattern first, then by name as the locale has it, numbers by their value and
    letters without case or accents."""
    return [F.coalesce(F.col("regex_pattern"), F.lit("")) == "", F.collate(natural_key(F.col("name")), locale), F.col("id")]


def recognition_order(catalog: DataFrame, locale: str = "zh_CI_AI") -> DataFrame:
    return catalog.orderBy(*recognition_columns(locale))


def regex_types(catalog: DataFrame) -> DataFrame:
    return catalog.where("enabled and regex_pattern is not null")


def rules_of(catalog: DataFrame, priority: int = 5) -> list[Rule]:
    """The patterns of a catalog's enabled types as rules, so that a person's own types are found too."""
    return [Rule(r["id"], r["regex_pattern"], priority) for r in listed(regex_types(catalog)).select("id", "regex_pattern").collect()]


def model_types(catalog: DataFrame) -> DataFrame:
    return catalog.where("enabled and use_llm")


def created(catalog: DataFrame, row: dict) -> DataFrame:
    """With a new type, named by chance unless it has an id."""
    full = {"id": f"custom_{uuid.uuid4().hex[:8]}", "order": CUSTOM_ORDER, "enabled": True, "use_llm": True, "name": None, "category": None, "risk_level": 3, "regex_pattern": None, "tag_template": None} | row
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in catalog.schema])
    return catalog.unionByName(catalog.sparkSession.createDataFrame([tuple(full[c] for c in catalog.columns)], schema))


def updated(catalog: DataFrame, id_: str, patch: dict) -> DataFrame:
    """With the fields of ``patch`` that are set."""
    new = {k: F.when(F.col("id") == id_, F.lit(v).cast(catalog.schema[k].dataType)).otherwise(F.col(k)) for k, v in patch.items() if v is not None}
    return catalog.withColumns(new) if new else catalog


def deleted(catalog: DataFrame, id_: str, protected: list[str]) -> DataFrame:
    if id_ in protected:
        raise ValueError(f"{id_} is a preset")
    return catalog.where(F.col("id") != id_)


def toggled(catalog: DataFrame, id_: str) -> DataFrame:
    return catalog.withColumn("enabled", F.when(F.col("id") == id_, ~F.col("enabled")).otherwise(F.col("enabled")))


def applied_preset(ids: Column, enabled: Column) -> Column:
    """A preset's ids that are enabled, in its order."""
    return F.array_intersect(ids, enabled)


def imported(presets: DataFrame, new: DataFrame, *, replace: bool = False) -> DataFrame:
    return new if replace else merged(presets, new)


def redaction_config(config: Column, default_mode: str = "structured") -> dict[str, Column]:
    """The options of a job's JSON with their defaults."""
    get = lambda k: F.get_json_object(config, f"$.{k}")
    return {
        "replacement_mode": F.coalesce(get("replacement_mode"), F.lit(default_mode)),
        "entity_type_ids": F.coalesce(F.from_json(get("entity_type_ids"), "array<string>"), F.array().cast("array<string>")),
        "custom_replacements": F.coalesce(F.from_json(get("custom_replacements"), "map<string,string>"), F.create_map().cast("map<string,string>")),
        "image_redaction_method": get("image_redaction_method"),
        "image_redaction_strength": F.coalesce(F.nullif(get("image_redaction_strength").try_cast("int"), F.lit(0)), F.lit(25)),
        "image_fill_color": F.coalesce(F.nullif(get("image_fill_color"), F.lit("")), F.lit("#000000")),
    }


def wizard_step(config: Column) -> Column:
    """The furthest step, 1 to 5, from a number or text of one; booleans and anything else give null."""
    raw = F.get_json_object(config, "$.wizard_furthest_step")
    n = X.strip(raw).try_cast("double").cast("int")
    return F.when(~raw.isin("true", "false") & n.between(1, 5), n)


def step_one_done(config: Column, job_type: Column) -> Column:
    size = lambda k: F.coalesce(F.size(F.from_json(F.get_json_object(config, f"$.{k}"), "array<string>")), F.lit(0))
    return F.when(job_type == "text_batch", size("entity_type_ids") > 0).otherwise((size("ocr_has_types") > 0) | (size("has_image_types") > 0))


def preset_pipelines(spark: SparkSession) -> DataFrame:
    """The two ways an image is read, with the types of each."""
    image = [(slug, name, k, True) for k, (slug, name) in enumerate(V.IMAGE_TYPES)]
    return spark.createDataFrame([("ocr_has", True, [(*t, True) for t in V.OCR_TYPES]), ("has_image", True, image)], PIPELINES)


def merged_pipelines(base: DataFrame, stored: DataFrame, dropped: str = "glm_vision") -> DataFrame:
    """Stored pipelines set what their preset has enabled and its types; others join as they are; one that is no more goes."""
    kept = stored.where(F.col("mode") != dropped)
    own = kept.select("mode", F.struct("enabled", "types").alias("_s"))
    known = base.join(own, "mode", "left").select("mode", F.coalesce("_s.enabled", "enabled").alias("enabled"), F.coalesce("_s.types", "types").alias("types"))
    return known.unionByName(kept.join(base.select("mode"), "mode", "left_anti").select("mode", "enabled", "types"))


def pipeline_types(pipelines: DataFrame, *, enabled_only: bool = True) -> DataFrame:
    """A row per pipeline and type, with its ``rank`` by order."""
    kept = F.filter("types", lambda t: t["enabled"]) if enabled_only else F.col("types")
    placed = F.array_sort(F.transform(kept, lambda t, i: F.struct(t["order"].alias("order"), i.alias("i"), t.alias("t"))))
    return pipelines.select("mode", F.posexplode(placed).alias("pos", "p")).select("mode", (F.col("pos") + 1).alias("rank"), "p.t.*")


def with_type(pipelines: DataFrame, mode: str, type_: dict, *, replace: bool = False) -> DataFrame:
    """With a type added to a pipeline, or with ``replace`` in place of the one of its id; an added id that is there stays as it is."""
    new = F.struct(*[F.lit(type_[k]).alias(k) for k in ("id", "name", "order", "enabled")])
    there = F.exists("types", lambda t: t["id"] == type_["id"])
    swapped = F.transform("types", lambda t: F.when(t["id"] == type_["id"], new).otherwise(t))
    types = F.when(there, swapped if replace else F.col("types")).otherwise(F.col("types") if replace else F.concat("types", F.array(new)))
    return pipelines.withColumn("types", F.when(F.col("mode") == mode, types).otherwise(F.col("types")))


def with_type_toggled(pipelines: DataFrame, mode: str, id_: str) -> DataFrame:
    types = F.transform("types", lambda t: F.when(t["id"] == id_, t.withField("enabled", ~t["enabled"])).otherwise(t))
    return pipelines.withColumn("types", F.when(F.col("mode") == mode, types).otherwise(F.col("types")))


def without_type(pipelines: DataFrame, mode: str, id_: str, protected: list[str]) -> DataFrame:
    if id_ in protected:
        raise ValueError(f"{id_} is a preset; it can only be disabled")
    return pipelines.withColumn("types", F.when(F.col("mode") == mode, F.filter("types", lambda t: t["id"] != id_)).otherwise(F.col("types")))


def merged_models(builtin: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored models without a name or id go; the built-in ones are always there, as stored if they are."""
    good = stored.where((F.trim(F.coalesce("id", F.lit(""))) != "") & (F.trim(F.coalesce("name", F.lit(""))) != ""))
    return merged(builtin, good)


def active_model(models: DataFrame, active_id: str) -> DataFrame:
    """The model pointed to, else the first that is enabled."""
    best = F.min_by(F.struct(*models.columns), F.struct((F.col("id") != active_id).alias("other"), (~F.col("enabled")).alias("off"), "id"))
    return models.agg(best.alias("m")).select("m.*")
