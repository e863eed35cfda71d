"""Column functions: strings, scores, vectors and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The emotions an annotation may name, and the texts that mark a placeholder.
EMOTIONS = [
    "tension", "melancholy", "awe", "joy", "sadness", "catharsis", "serenity", "excitement", "dread", "nostalgia", "admiration",
    "intimacy", "vulnerability", "longing", "desire", "other",
]
PLACEHOLDERS = [
    "what you see", "one word", "one reason", "2-3 observations", "2-4 qualities", "3-5 keywords", "why this works as a gif",
    "describe what you actually see", "describe actual visible subjects", "concise description", "what you actually observe",
    "one personal cinephile reason",
]
#: What counts as white space around a text.
BLANKS = " \t\n\r\x0b\x0c"
#: Worthiness of a word used in place of a number.
WORTH_WORDS = {"excellent": 0.9, "good": 0.7, "average": 0.4, "bad": 0.15}


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def film_name(path: Column) -> Column:
    """X-01: the file stem up to its first separator after a character, unless that is one character or all digits: then the stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), r"\.[^.]*$", "")
    head = strip(F.regexp_extract(stem, r"^(.+?)[-_\s.]+.*$", 1))
    return F.when((F.length(head) >= 2) & ~head.rlike("^[0-9]+$"), head).otherwise(stem)


def scenario_keys(emotion: Column, scene: Column, tags: Column) -> Column:
    """X-02: sorted distinct ``emotion:``, ``scene:`` and ``tag:`` keys of what is not blank."""
    clean = lambda kind, x: F.when(F.trim(x) != "", F.concat(F.lit(f"{kind}:"), F.lower(F.trim(x))))
    keys = F.concat(F.array(clean("emotion", emotion), clean("scene", scene)), F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: clean("tag", t)))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def canonical_emotion(raw: Column) -> Column:
    """X-03: a known emotion, or the first known part of a list by bar or comma, or ``other``."""
    parts = F.filter(F.transform(F.split(F.translate(F.lower(raw), "|", ","), ","), strip), lambda x: x.isin(EMOTIONS))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("other"))


def placeholders(text: Column) -> Column:
    """X-04: the placeholder texts within; ``empty`` for a blank one."""
    low = F.lower(strip(F.coalesce(text, F.lit(""))))
    none = F.array().cast("array<string>")
    found = F.concat(*(F.when(F.contains(low, F.lit(p)), F.array(F.lit(p))).otherwise(none) for p in PLACEHOLDERS))
    return F.when(low == "", F.array(F.lit("empty"))).otherwise(found)


def worthiness(value: Column) -> Column:
    """X-05: a number clamped to [0, 1], the value of a word, or one half."""
    number = value.try_cast("double")
    words = reduce(lambda w, kv: w.when(F.contains(F.lower(value), F.lit(kv[0])), kv[1]), WORTH_WORDS.items(), F.when(number.isNotNull() & ~F.isnan(number), clamp(number)))
    return words.otherwise(0.5)


def clip_interval(name: Column) -> Column:
    """X-07: struct(start, end) in seconds from ``@@@NNN_<a>ms-<b>ms.gif`` or the form in seconds; (0, 0) else."""
    ms, sec = r"@@@\d+_(\d+)ms-(\d+)ms\.gif$", r"@@@\d+_(\d+(?:\.\d+)?)s?-(\d+(?:\.\d+)?)s?\.gif$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(name, ms, i), F.lit("")).cast("double") / 1000, F.nullif(F.regexp_extract(name, sec, i), F.lit("")).cast("double"), F.lit(0.0))
    return F.struct(part(1).alias("start"), part(2).alias("end"))


def clip_name(video: Column, index: Column, start: Column, end: Column) -> Column:
    """X-07, the other way."""
    ms = lambda x: F.round(x * 1000).cast("long").cast("string")
    return F.concat(video, F.lit("@@@"), F.lpad(index.cast("string"), 3, "0"), F.lit("_"), ms(start), F.lit("ms-"), ms(end), F.lit("ms.gif"))


def label(text: Column, most: int = 60) -> Column:
    """X-12: at most ``most`` characters, the last three dots if cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def caption_label(caption: Column, summary: Column, status: Column, kind: str = "Candidate") -> Column:
    """X-12: a candidate's label: its caption, else its summary, trimmed and cut; without either the kind and its status."""
    said = strip(F.when(F.coalesce(caption, F.lit("")) != "", caption).otherwise(F.coalesce(summary, F.lit(""))))
    return F.when(said != "", label(said)).otherwise(F.concat(F.lit(f"{kind} "), F.when(F.coalesce(status, F.lit("")) != "", status).otherwise("candidate")))


def scene_label(label_: Column, scene_type: Column, status: Column) -> Column:
    """X-12: a scene's label: that of its score, else its type, else ``Scene`` and its status."""
    return F.coalesce(label_, scene_type, F.concat(F.lit("Scene "), F.when(F.coalesce(status, F.lit("")) != "", status).otherwise("candidate")))


def readable_error(raw: Column) -> Column:
    """X-13: the message, or else the error, of a JSON object, else the first 200 characters; a sentence where there is nothing."""
    text = strip(raw)
    of_json = F.when(F.startswith(text, F.lit("{")), F.coalesce(F.get_json_object(text, "$.message"), F.get_json_object(text, "$.error")))
    return F.when(F.coalesce(raw, F.lit("")) == "", "No error details recorded.").otherwise(F.coalesce(of_json, F.substring(text, 1, 200)))


def strict_json(raw: Column, schema: str) -> Column:
    """X-06, X-24: a struct from a model's answer: think tags and code fences stripped, then the text, else the first of its
    balanced objects that is JSON."""
    text = strip(F.element_at(F.split(raw, "</think>"), -1))
    text = F.when(F.startswith(text, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", ""))).otherwise(text)
    good = lambda t: F.get_json_object(t, "$").isNotNull()
    inner = F.try_element_at(F.filter(balanced(text), good), F.lit(1))
    return F.from_json(F.when(good(text), text).otherwise(inner), schema)


def balanced(text: Column) -> Column:
    """The outermost ``{...}`` of a text, in order; one pass over its characters."""
    kind = "struct<at:int,depth:int,start:int,found:array<string>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.array().cast("array<string>").alias("found")).cast(kind)

    def step(s: Column, c: Column) -> Column:
        at = s.at + 1
        depth = s.depth + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        start = F.when((c == "{") & (s.depth == 0), at).otherwise(s.start)
        ends = (c == "}") & (depth == 0) & (s.start > 0)
        found = F.when(ends, F.array_append(s.found, F.substring(text, s.start, at - s.start + 1))).otherwise(s.found)
        return F.struct(at.alias("at"), depth.alias("depth"), start.alias("start"), found.alias("found")).cast(kind)

    return F.aggregate(F.split(text, ""), zero, step, lambda s: s.found)


def dot(a: Column, b: Column) -> Column:
    """X-14: inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """X-14: the vector over its length; a zero vector stays."""
    by = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))
    return F.transform(F.array(norm(a)), by)[0]  # the length is a variable here, so that it is found once and not for each position


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(n.isNotNull(), 0.0)


def hash_bits(hex_hash: Column) -> Column:
    """A 64-bit hash of 16 hex digits as a signed long; null if it isn't one."""
    return F.when(hex_hash.rlike("^[0-9a-fA-F]{16}$"), F.conv(hex_hash, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """X-15: bits that differ; 64 for a bad hash."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def export_window(span: Column, worth: Column, frames: Column, at: Column, least: float = 2.0, most: float = 6.0) -> Column:
    """X-17: struct(start, duration) of the clip to export."""
    length = F.when(frames > 1, F.least(span + 3, F.lit(most + 2))).otherwise(least + (most - least) * worth)
    return F.struct(F.greatest(F.lit(0.0), at - 0.4 * length).alias("start"), length.alias("duration"))


def blend(parts: list[tuple[Column, float]]) -> Column:
    """X-18: weighted mean; weights must not be negative nor sum to 0."""
    total = sum(w for _, w in parts)
    if total <= 0 or any(w < 0 for _, w in parts):
        raise ValueError("weights must not be negative and must have a positive sum")
    return reduce(lambda a, b: a + b, (c * (w / total) for c, w in parts))


def min_max(value: Column, least: Column, most: Column) -> Column:
    """X-16: the value's place between the pool's least and greatest, one half where they are equal; null counts as 0."""
    return F.coalesce(F.when(most - least < 1e-12, F.lit(0.5)).otherwise((value - least) / (most - least)), F.lit(0.0))


def ids_hash(ids: Column) -> Column:
    """A-24: sha256 of the sorted ids as a JSON list, in a row that holds them."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('"'))), ", "), F.lit("]")), 256)
