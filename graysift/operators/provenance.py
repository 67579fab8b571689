"""Provenance labels: fingerprints, the registry lookup, tags, and the geometry and codec choices of a visible badge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.operators.detect import let

# Names of the tags, containers that keep a burnt-in badge, and which audio a container takes unchanged.
CONTAINERS = ("mp4", "mov", "m4v", "mkv", "webm")
TAGS = {"AILABEL_ID": "id", "AILABEL_DST": "digitalSourceType", "AILABEL_SIG": "sig", "AILABEL_KEYID": "keyId", "AILABEL_SHA256": "sha256Original", "AILABEL_VERIFY": "verifyUrl"}
AUDIO_KEPT = {"mp4": "^(aac|mp3|ac3|eac3|alac)$", "m4v": "^(aac|mp3|ac3|eac3|alac)$", "mov": r"^(aac|mp3|ac3|eac3|alac|pcm_\w+)$", "webm": "^(opus|vorbis)$"}
POSITIONS = {
    "linksboven": "linksboven", "rechtsboven": "rechtsboven", "linksonder": "linksonder", "rechtsonder": "rechtsonder", "lb": "linksboven", "rb": "rechtsboven", "lo": "linksonder",
    "ro": "rechtsonder", "top-left": "linksboven", "top-right": "rechtsboven", "bottom-left": "linksonder", "bottom-right": "rechtsonder", "tl": "linksboven", "tr": "rechtsboven",
    "bl": "linksonder", "br": "rechtsonder",
}


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def check_registry(files: DataFrame, registry: DataFrame, sha_col: str = "sha256", tag_col: str = "tag_id") -> DataFrame:
    """files with state and label_id: labelled (signature valid, invalid or unknown), edited (a tag, but a fingerprint
    that is not registered) or unlabelled. A left join on the fingerprint; the first label of one counts."""
    known = registry.groupBy(F.col("sha256").alias("__sha")).agg(F.min_by(F.struct("label_id", "signature_valid"), "label_id").alias("__r"))
    rows = files.join(known, F.col(sha_col) == F.col("__sha"), "left")
    valid = F.col("__r.signature_valid")
    state = (
        F.when(F.col("__r").isNotNull() & valid, "labelled, signature valid").when(F.col("__r").isNotNull() & ~valid, "labelled, signature invalid")
        .when(F.col("__r").isNotNull(), "labelled, signature unknown").when(F.col(tag_col).isNotNull(), "possibly edited").otherwise("not labelled")
    )
    return rows.withColumn("state", state).withColumn("label_id", F.coalesce("__r.label_id", tag_col)).drop("__sha", "__r")


def tag_map(compact: Column, extra: Column | None = None) -> Column:
    """The tags to embed, from a label (a struct with the fields of TAGS, and disclosure)."""
    tags = F.create_map(*[x for tag, field in TAGS.items() for x in (F.lit(tag), compact[field].cast("string"))])
    comment = F.create_map(F.lit("comment"), F.concat(compact["disclosure"], F.lit(" ["), compact["id"], F.lit("] "), compact["verifyUrl"]))
    rest = [extra] if extra is not None else []
    return F.map_from_entries(F.concat(*[F.map_entries(m) for m in (tags, *rest, comment)]))


PROBE = (
    "struct<format:struct<tags:map<string,string>,duration:string,bit_rate:string>,streams:array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,"
    "sample_aspect_ratio:string,duration:string,bit_rate:string,color_space:string,color_range:string,tags:map<string,string>,disposition:struct<attached_pic:int>,"
    "side_data_list:array<struct<rotation:double>>>>>"
)


def probe_tags(probe: Column) -> Column:
    """struct<id, verify, comment> of a media probe's JSON, names in any letter case. A stream's tag replaces one of the
    same spelling, of the file or of a stream before it; of several spellings the one that came first counts."""
    p = F.from_json(probe, PROBE)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    streams = F.flatten(F.transform(p["streams"], lambda s: F.map_entries(F.coalesce(s["tags"], none))))
    entries = F.concat(F.coalesce(F.map_entries(p["format"]["tags"]), F.map_entries(none)), F.coalesce(streams, F.map_entries(none)))

    def get(name: str) -> Column:
        named = F.filter(entries, lambda e: F.lower(e["key"]) == name)
        return let(named, lambda n: F.try_element_at(F.filter(n, lambda e: e["key"] == F.get(n, F.lit(0))["key"]), F.lit(-1))["value"])

    return F.struct(get("ailabel_id").alias("id"), get("ailabel_verify").alias("verify"), get("comment").alias("comment"))


def probe_video(probe: Column) -> Column:
    """struct of the first video stream that is no cover: index, width and height as shown, sar, rotation, duration,
    bit_rate, color_space, color_range, audio_codecs; null without one."""
    p = F.from_json(probe, PROBE)
    v = F.get(F.filter(p["streams"], lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    side = F.element_at(F.filter(F.transform(v["side_data_list"], lambda d: d["rotation"]), lambda r: r.isNotNull()), -1)
    side = F.when(F.size(F.filter(v["side_data_list"], lambda d: d["rotation"].isNotNull())) > 0, side)
    rotation = F.when(F.coalesce(side, F.lit(0.0)) != 0, side).otherwise(F.coalesce(F.try_element_at(v["tags"], F.lit("rotate")).try_cast("double"), F.lit(0.0)))
    swap = F.abs(rotation) % 180 == 90
    sar = F.split(F.coalesce(v["sample_aspect_ratio"], F.lit("1:1")), ":")
    sn, sd = F.get(sar, F.lit(0)).try_cast("double"), F.get(sar, F.lit(1)).try_cast("double")
    number = lambda *cs: F.coalesce(*[F.when(c.try_cast("double") != 0, c.try_cast("double")) for c in cs], F.lit(0.0))
    info = F.struct(
        v["index"].alias("index"), F.when(swap, v["height"]).otherwise(v["width"]).alias("width"), F.when(swap, v["width"]).otherwise(v["height"]).alias("height"),
        F.when(~swap & (sn > 0) & (sd > 0), sn / sd).otherwise(1.0).alias("sar"), rotation.alias("rotation"), number(p["format"]["duration"], v["duration"]).alias("duration"),
        number(v["bit_rate"], p["format"]["bit_rate"]).alias("bit_rate"), F.coalesce(v["color_space"], F.lit("")).alias("color_space"), F.coalesce(v["color_range"], F.lit("")).alias("color_range"),
        F.transform(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), lambda s: F.coalesce(s["codec_name"], F.lit(""))).alias("audio_codecs"),
    )
    return F.when((v["width"] > 0) & (v["height"] > 0), info)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def badge(width: Column, height: Column, sar: Column, scale: Column, text_width: Column, position: Column) -> Column:
    """struct<height, margin, width, x, y, image_width, image_height, scaled_width>: a badge one sixteenth of the short
    side high (20 pixels and a quarter of it are the bounds), shrunk to fit the width. text_width: the badge's width for
    each pixel of its height. The image has a rim around the badge; x, y and scaled_width are the image's, in stored pixels.
    """
    shown = width * sar
    short = F.least(shown, height.cast("double"))
    margin = lambda h: half_up(F.greatest(h * 0.5, short * 0.03))
    h0 = half_up(F.least(short / 4, F.greatest(F.lit(20.0), short / 16 * scale)))
    most = shown - 2 * margin(h0)
    wide = F.ceil(h0 * text_width)
    h = F.when(wide > most, F.greatest(F.lit(12), F.floor(h0 * most / wide))).otherwise(h0)
    w, m = F.ceil(h * text_width), margin(h)
    bx, by = F.when(position.startswith("rechts"), shown - w - m).otherwise(m.cast("double")), F.when(position.endswith("onder"), height - h - m).otherwise(m)
    pad = F.greatest(F.lit(1), half_up(h * 0.025)) + 1
    found = {
        "height": h, "margin": m, "width": w, "x": half_up((bx - pad) / sar), "y": half_up(by - pad), "image_width": w + 2 * pad, "image_height": h + 2 * pad,
        "scaled_width": F.greatest(F.lit(1), half_up((w + 2 * pad) / sar)),
    }
    return F.struct(*[c.cast("long").alias(n) for n, c in found.items()])


def text_width(small: Column, widths: Column) -> Column:
    """The badge's width for each pixel of its height: widths holds the width of each line of text for each pixel of its
    size, small which lines are small. Without lines the badge is a square."""
    two = F.size(widths) == 2
    sizes = F.transform(small, lambda s: F.when(s, F.when(two, 0.21).otherwise(0.28)).otherwise(F.when(two, 0.40).otherwise(0.46)))
    return F.when(F.size(widths) == 0, 1.0).otherwise(1.28 + F.array_max(F.zip_with(sizes, widths, lambda s, w: s * w)) + 0.40)


def overlay_filter(index: Column, badge_: Column, matrix: Column, color_range: Column, seconds: Column) -> Column:
    """The text of the filter that lays a badge's image over a video, for the first ``seconds`` if there are any."""
    enable = F.when(seconds > 0, F.concat(F.lit(":enable='lte(t,"), seconds.cast("string"), F.lit(")'"))).otherwise("")
    scale = F.format_string("[1:v]scale=w=%d:h=%d:out_color_matrix=%s:out_range=%s,format=yuva420p[lg];", badge_["scaled_width"], badge_["image_height"], matrix, F.when(color_range == "pc", "pc").otherwise("tv"))
    return F.concat(scale, F.format_string("[0:%d][lg]overlay=x=%d:y=%d", index, badge_["x"], badge_["y"]), enable, F.lit("[v]"))


def bit_rate(known: Column) -> Column:
    """For the encoder that takes a rate: half as much again as the video has, 4 Mbit/s at least."""
    return F.greatest(F.lit(4_000_000).cast("long"), half_up(F.coalesce(known, F.lit(0.0)) * 1.5))


def sidecar(path: Column, manifest: Column) -> Column:
    """struct<path, content> of the file beside a labelled one that holds its manifest."""
    return F.struct(F.concat(path, F.lit(".manifest.json")).alias("path"), F.to_json(manifest, {"pretty": "true"}).alias("content"))


def registration_facts(files: DataFrame, id_col: str = "label_id", sha_col: str = "sha256", marked_col: str = "marked_sha256") -> DataFrame:
    """The rows for a registry: one of the original fingerprint and, where there is a marked file, one of its own."""
    first = files.select(F.col(id_col).alias("label_id"), F.col(sha_col).alias("sha256"), F.lit("original").alias("kind"))
    marked = files.filter(F.col(marked_col).isNotNull()).select(F.col(id_col), F.col(marked_col), F.lit("marked"))
    return first.union(marked)


def position(name: Column) -> Column:
    """The corner that a name or an abbreviation means; null if it means none."""
    key = F.regexp_replace(F.trim(F.lower(name)), r"[\s_]+", "-")
    table = F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair])
    joined = F.replace(key, F.lit("-"), F.lit(""))
    return F.try_element_at(table, F.when(joined.isin(*sorted(set(POSITIONS.values()))), joined).otherwise(key))


def audio_choice(container: Column, codecs: Column) -> Column:
    """copy if the container takes all audio as it is, else opus for webm and aac for the others."""
    all_match = lambda pattern: F.forall(codecs, lambda c: c.rlike(pattern))
    fits = F.lit(True)
    for name, pattern in AUDIO_KEPT.items():
        fits = F.when(container == name, all_match(pattern)).otherwise(fits)
    return F.when(fits, "copy").when(container == "webm", "libopus 160k").otherwise("aac 192k")


def color_matrix(space: Column, width: Column, height: Column) -> Column:
    by_size = F.when((height >= 720) | (width >= 1280), "bt709").otherwise("bt601")
    return F.when(space == "bt709", "bt709").when(space.rlike("bt470bg|smpte170m"), "bt601").when(space.startswith("bt2020"), "bt2020").otherwise(by_size)


def crf(container: Column, asked: Column) -> Column:
    return F.coalesce(asked, F.when(container == "webm", 31).otherwise(18))


def short_label(manipulated: Column, deep_fake: Column, lang: Column) -> Column:
    english = F.coalesce(lang, F.lit("nl")) == "en"
    base = F.when(manipulated, F.when(english, "AI-manipulated").otherwise("AI-bewerkt")).otherwise(F.when(english, "AI-generated").otherwise("AI-gegenereerd"))
    return F.when(deep_fake, F.concat(F.lit("Deep fake · "), base)).otherwise(base)


def output_path(path: Column, burned: Column | None = None) -> Column:
    """.ailabel before the extension. burned: whether a badge is laid over the video; containers that cannot keep that become
    mp4."""
    named = F.when(path.rlike(r"[^/.][^/]*\.[^./]*$"), F.regexp_replace(path, r"(\.[^./]*)$", ".ailabel$1")).otherwise(F.concat(path, F.lit(".ailabel")))
    if burned is None:
        return named
    kept = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*CONTAINERS)
    return F.when(burned & ~kept, F.regexp_replace(named, r"\.[^.]+$", ".mp4")).otherwise(named)
