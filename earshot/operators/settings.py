"""Settings and presets as tables: knobs under a named preset, scenes as JSON files, lists to choose from, pools of a set, and what a reset leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.operators.catalogue import nocase
from earshot.sources.stores import clear_table, committed, read_table, replace_table

# What every layer of a scene has where its file says nothing.
LAYER = "visible boolean, opacity double, blend string, parent string, x double, y double, scale double, rotation double, props string, bind string"
DEFAULTS = {"visible": True, "opacity": 1.0, "blend": "source-over", "parent": None, "x": 0.0, "y": 0.0, "scale": 1.0, "rotation": 0.0, "props": "{}", "bind": "{}"}
SCENE_VERSION = 1
# What a curve's file ends in, after its suffix, and what a file is called that has no other name.
CURVE_ENDINGS, NAMELESS = (r"(?i)\s*Parametric ?EQ\s*$", r"(?i)\s*GraphicEQ\s*$"), "AutoEq"
#: The label of knobs that are no preset's.
CUSTOM = "custom"


def knobs_now(changes: DataFrame, presets: DataFrame) -> DataFrame:
    """owner, label, knob, value after all changes (owner, seq, preset or knob with value), in order of seq. Choosing a preset (presets: preset, knob, value)
    sets all its knobs; turning one knob afterwards sets it alone, and the label is "custom" from then on."""
    last = changes.where("preset is not null").groupBy("owner").agg(F.max(F.struct("seq", "preset")).alias("p"))
    turned = changes.where("knob is not null").join(last, "owner", "left").where("p is null or seq > p.seq")
    turned = turned.groupBy("owner", "knob").agg(F.max_by("value", "seq").alias("turned"))
    set_ = last.select("owner", F.col("p.preset").alias("preset")).join(presets, "preset").select("owner", "knob", "value")
    owners = changes.select("owner").distinct().join(last.select("owner", F.col("p.preset").alias("preset")), "owner", "left")
    custom = turned.select("owner").distinct().withColumn("custom", F.lit(True))
    label = owners.join(custom, "owner", "left").select("owner", F.when(F.col("custom") | F.col("preset").isNull(), CUSTOM).otherwise(F.col("preset")).alias("label"))
    values = set_.join(turned, ["owner", "knob"], "full").select("owner", "knob", F.coalesce("turned", "value").alias("value"))
    return label.join(values, "owner").select("owner", "label", "knob", "value")


def scene_files(scenes: DataFrame, kind: str = "scene") -> DataFrame:
    """id, text: a JSON file of each scene (id, name, layers: a list of structs)."""
    return scenes.select("id", F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(SCENE_VERSION).alias("version"), F.struct("name", "layers").alias("scene"))).alias("text"))


def parsed_scenes(files: DataFrame) -> DataFrame:
    """id, name, layers, error of scene files (id, text): a scene in its wrapper or bare, each layer filled by what it lacks. A text that is no JSON, has no name or no list of layers has an error and nothing else."""
    layer = LAYER.replace("parent string", "id string, type string, parent string")
    inner = f"struct<name: string, layers: array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in layer.split(', '))}>>>"
    t = files.select("id", F.try_parse_json("text").alias("json"), "text")
    wrapped = F.get_json_object("text", "$.scene").isNotNull()
    raw = F.when(wrapped, F.get_json_object("text", "$.scene")).otherwise(F.col("text"))
    t = t.select("id", "json", F.from_json(raw, inner.removeprefix("struct<").removesuffix(">").replace("name: string, layers: ", "name string, layers ")).alias("s"), F.get_json_object(raw, "$.layers").alias("list"))
    error = F.when(F.col("json").isNull(), "not valid JSON").when(F.col("s.name").isNull() | ~F.coalesce(F.startswith("list", F.lit("[")), F.lit(False)), "not a scene")
    fields = [c.split()[0] for c in layer.split(", ")]
    full = F.transform("s.layers", lambda x: F.struct(*[(F.coalesce(x[c], F.lit(DEFAULTS[c])) if DEFAULTS.get(c) is not None else x[c]).alias(c) for c in fields]))
    ok = error.isNull()
    return t.select("id", F.when(ok, F.col("s.name")).alias("name"), F.when(ok, full).alias("layers"), error.alias("error"))


def presets_shown(presets: DataFrame, category: str = "all", search: str = "") -> DataFrame:
    """Presets (source: built, user, assigned or device; name, sub, graphic) of a category whose name or second line holds a text, whatever its case."""
    own = F.col("source").isin("built", "user")
    rules = {"graphic": own & F.col("graphic"), "parametric": own & ~F.col("graphic"), "user": F.col("source") == "user", "assigned": F.col("source") == "assigned", "device": F.col("source") == "device"}
    needle = search.strip().lower()
    shown = presets.where(rules.get(category, F.lit(True)))
    return shown.where(F.contains(F.lower("name"), F.lit(needle)) | F.contains(F.lower("sub"), F.lit(needle))) if needle else shown


def set_pool(tracks: DataFrame, genre: str | None = None, subgenre: str | None = None) -> DataFrame:
    """Tracks of a genre and a sub-genre, A to Z in any case; None is any."""
    same = lambda c, want: F.lit(True) if want is None else nocase(c) == nocase(F.lit(want))
    return tracks.where(same("genre", genre) & same("subgenre", subgenre))


def headphone_name(name):
    """What a curve's file says of the headphones it is for."""
    c = F.col(name) if isinstance(name, str) else name
    c = F.regexp_replace(c, r"\.[^.]+$", "")
    for ending in CURVE_ENDINGS:
        c = F.regexp_replace(c, ending, "")
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(NAMELESS))


def reset_taste(spark: SparkSession, folder: str, learnt: tuple[str, ...] = ("model", "events", "last_played")) -> None:
    """Empty what was learnt from listening; other states in the folder, such as fingerprints and recipes, stay."""
    for name in learnt:
        if committed(spark, f"{folder}/{name}"):
            clear_table(spark, f"{folder}/{name}")


def reclustered(vectors: DataFrame, folder: str, make) -> tuple[DataFrame, bool]:
    """The clusters of vectors and whether they were made now: make(vectors) is called only if their number is another one than when the stored ones were made."""
    spark, n = vectors.sparkSession, vectors.count()
    if committed(spark, folder):
        kept = read_table(spark, folder)
        if kept.where(F.col("made_of") != n).limit(1).count() == 0 and kept.limit(1).count():
            return kept.drop("made_of"), False
    replace_table(make(vectors).withColumn("made_of", F.lit(n).cast("long")), folder)
    return read_table(spark, folder).drop("made_of"), True


def lasting(rows: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Rows of sound long enough to be measured."""
    return rows.where(F.col("duration") >= seconds)


def recent_list(rows: DataFrame, most: int, newest_first: bool = True) -> DataFrame:
    """pos, seq: the last most tracks played, in one order or the other."""
    last = rows.where("last_played > 0").orderBy(F.desc("last_played"), "seq").limit(most)
    by = (F.desc("last_played"), F.col("seq")) if newest_first else (F.col("last_played"), F.desc("seq"))
    return last.select((F.row_number().over(Window.orderBy(*by)) - 1).alias("pos"), "seq")
