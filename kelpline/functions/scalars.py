"""Scalar column functions: keys, clock arithmetic, vocabularies, arrays, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The arousal rubric by activity and by posture, and the share of activity in it.
ACTIVITY_AROUSAL = {"still": 0.0, "low": 0.33, "moderate": 0.66, "high": 1.0}
POSTURE_AROUSAL = {"contracted": 0.0, "neutral": 0.3, "arms_extended": 0.6, "climbing": 0.8, "flattened_spread": 1.0, "uncertain": 0.3}
ACTIVITY_SHARE = 0.6


def lookup(table: dict, key: Column, default) -> Column:
    """The table's value, or the default for an unknown or null key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def arousal(activity: Column, posture: Column) -> Column:
    a, p = lookup(ACTIVITY_AROUSAL, activity, 0.33), lookup(POSTURE_AROUSAL, posture, 0.3)
    return F.round(a * ACTIVITY_SHARE + p * (1 - ACTIVITY_SHARE), 3)


# --- keys -----------------------------------------------------------------------


def path_tail(path: Column, parts: int = 3) -> Column:
    """The last parts of a path, joined by /; all of it where it has fewer."""
    split = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    return F.array_join(F.slice(split, F.greatest(F.size(split) - (parts - 1), F.lit(1)), parts), "/")


def source_of_key(key: Column) -> Column:
    return F.substring_index(key, "/", 2)


def source_of_path(path: Column) -> Column:
    """The two folders above the file; null where there are fewer."""
    split = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    return F.when(F.size(split) >= 3, F.concat_ws("/", F.try_element_at(split, F.lit(-3)), F.try_element_at(split, F.lit(-2))))


def flat_id(path: Column, prefix: str, suffix: str) -> Column:
    rest = F.when(path.contains(prefix), F.substring_index(path, prefix, -1)).otherwise(path)
    return F.replace(F.replace(rest, F.lit("/"), F.lit("_")), F.lit(suffix), F.lit(""))


def clock_hour(segment: Column, offset: Column) -> Column:
    """Hour of day of HHMMSS plus seconds; null for a malformed segment."""
    part = lambda i: F.substring(segment, i, 2).try_cast("int")
    return F.pmod(F.floor((part(1) * 3600 + part(3) * 60 + part(5) + offset) / 3600), F.lit(24)).cast("int")


def timeline(start: Column, end: Column) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minute = lambda t: F.concat(two(F.floor(t / 60).cast("int")), F.lit(":"), two(F.pmod(t, F.lit(60)).cast("int")))
    return F.concat(minute(start), F.lit("-"), minute(end))


def digits_before(name: Column, mark: str) -> Column:
    """Digits of the name's part before the mark; the whole name where there are none."""
    return F.coalesce(F.nullif(F.regexp_replace(F.split_part(name, F.lit(mark), F.lit(1)), "[^0-9]", ""), F.lit("")), name)


def capture(text: Column, pattern: str, group: int) -> Column:
    """A regex group; null where the pattern isn't found."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def md5_modulus(text: Column, modulus: int) -> Column:
    """The MD5 digest, read as one number, modulo ``modulus`` (below 2**31), folded over its four 32-bit parts."""
    digest = F.md5(text)
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    out = F.lit(0).cast("long")
    for p in parts:
        out = F.pmod(out * F.lit((1 << 32) % modulus) + p, F.lit(modulus).cast("long"))
    return out


def decoded(url: Column) -> Column:
    """A percent-coded url as text; a + is a +."""
    return F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def encoded(text: Column) -> Column:
    """Percent-coded, a space as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def votes_text(top: Column, n: Column) -> Column:
    """ "4/5"; "0/0" where there is no vote."""
    return F.concat_ws("/", F.coalesce(top, F.lit(0)).cast("string"), F.coalesce(n, F.lit(0)).cast("string"))


def votes_of(text: Column) -> tuple[Column, Column]:
    """The two numbers of a votes text; (0, 0) for a null or malformed one."""
    ok = F.coalesce(text.rlike("^[0-9]+/[0-9]+$"), F.lit(False))
    part = lambda i: F.when(ok, F.split_part(text, F.lit("/"), F.lit(i)).try_cast("int")).otherwise(0)
    return part(1), part(2)


def suffix_score(name: Column) -> Column:
    """The number in the four characters behind the first "_p"; null without one."""
    return F.substring(F.regexp_extract(name, "_p(.{1,4})", 1), 1, 4).try_cast("double")


def short_digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


# --- vocabularies and captions ------------------------------------------------------


def snap(value: Column, allowed: list[str], default: str) -> Column:
    """The legal value: the same, the same but for case and padding, or one that contains or is contained (first in
    sorted order, "uncertain" apart); otherwise, and for an empty text, the default."""
    low = F.lower(F.trim(value))
    words = F.array(*[F.lit(a) for a in sorted(allowed)])
    first = lambda ok: F.get(F.filter(words, ok), 0)
    near = first(lambda a: (a != "uncertain") & (low.contains(F.lower(a)) | F.lower(a).contains(low)))
    found = F.coalesce(F.when(value.isin(*allowed), value), first(lambda a: F.lower(a) == low), F.when(low != "", near))
    return F.coalesce(found, F.lit(default))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; otherwise the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def present_by_text(caption: Column, phrases: tuple[str, ...] = ("not present", "not visible")) -> Column:
    out = F.coalesce(caption, F.lit("")) != ""
    for p in phrases:
        out = out & ~F.lower(caption).contains(p)
    return F.coalesce(out, F.lit(False))


def reject_pattern(subject: str) -> str:
    """Fixed pattern, for the observed subject: captions that say it can't be seen."""
    return rf"(?i)not (visible|present) in (any|these|the (provided |given )?(frame|image))|^(the |an )?{subject} (is )?(not|is not) (visible|present)|no {subject} (is )?(visible|present)|remains hidden and not visible"


def usable_caption(caption: Column, subject: str) -> Column:
    """The caption less its label; null where it rejects or says nothing."""
    text = F.trim(caption)
    text = F.when(F.lower(text).startswith("caption:"), F.trim(F.substring(text, F.lit(9), F.length(text)))).otherwise(text)
    low = F.lower(text)
    bad = text.rlike(reject_pattern(subject)) | low.contains("not present") | low.isin("uncertain", "unknown", "")
    return F.when(~bad, text)


def labelled_line(reply: Column, label: str) -> Column:
    """The last line that starts with the label, without it and its quotes; null without one."""
    lines = F.regexp_extract_all(reply, F.lit(rf"(?im)^\s*{label}:[ \t]*([^\n]*)$"), F.lit(1))
    return F.btrim(F.trim(F.try_element_at(lines, F.lit(-1))), F.lit("'\""))


def parsed_reply(reply: Column, labels: list[str], absent: str = "not present") -> tuple[Column, Column]:
    """(caption, label) of a reply in labelled lines. Without a caption line the whole reply is the caption. A label is the
    listed one it names (equal, containing or contained, in the list's order), "uncertain" where it says so or nothing, and
    as it stands otherwise. Where either says ``absent``, the label is the listed one that does; where the caption does, the
    caption too."""
    gone = next((x for x in labels if absent in x.lower()), absent)
    said = labelled_line(reply, "ETHOGRAM")
    low = F.lower(said)
    named = F.get(F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: low.contains(F.lower(x)) | F.lower(x).contains(low)), 0)
    label = F.when(F.coalesce(said, F.lit("")) == "", "uncertain").when(low.isin("uncertain", "unknown"), "uncertain").when(low.contains(absent), gone).otherwise(F.coalesce(named, said))
    caption = F.coalesce(F.nullif(labelled_line(reply, "CAPTION"), F.lit("")), F.btrim(F.trim(reply), F.lit("'\"")))
    hidden = F.lower(caption).contains(absent)
    return F.when(hidden, gone).otherwise(caption), F.when(hidden, gone).otherwise(label)


def validated(reply: Column, fields: dict[str, tuple[list[str], str]]) -> Column:
    """A struct of a JSON reply's fields: each snapped to its vocabulary or default, ``present`` a truth value (null and absent:
    false), ``confidence`` a number (0 where it isn't one)."""
    value = lambda name: F.get_json_object(json_body(reply), f"$.{name}")
    present = F.coalesce(~F.lower(value("present")).isin("false", "0", "0.0", "null", "", "[]", "{}"), F.lit(False))
    snapped = [snap(value(name), allowed, default).alias(name) for name, (allowed, default) in fields.items()]
    return F.struct(present.alias("present"), *snapped, F.coalesce(value("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"))


def group_softmax(similarity: Column, positives: int, scale: float = 100.0) -> Column:
    """Probability of the first ``positives`` prompts as a group against the rest: softmax over the groups' scaled means."""
    mean = lambda a: total(a) / F.size(a)
    gap = (mean(F.slice(similarity, positives + 1, 1 << 20)) - mean(F.slice(similarity, 1, positives))) * scale
    return 1.0 / (1.0 + F.exp(gap))


def area_error(predicted: Column, truth: Column) -> Column:
    """Relative difference of two areas; an empty truth counts as one."""
    return F.abs(predicted - truth) / F.greatest(truth, F.lit(1))


def stamp(at: Column | None = None) -> Column:
    """A time to the second, as ISO text; now without one. For audits, not for results."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss")


def plain_json(*columns) -> Column:
    """Columns as a JSON object; numbers that aren't finite are null."""
    return F.to_json(F.struct(*[F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), F.col(c)).alias(c) if numeric else F.col(c) for c, numeric in columns]))


def scanned_seconds(end: Column, seconds: Column, batch: int = 64) -> Column:
    """How far a scan that stops at whole batches went to find what ends at ``end``: at most the length."""
    return F.least(F.ceil(end / batch) * batch, seconds)


def full_scan(n_probes: Column, seconds: Column, probe_max: Column, gate: float) -> Column:
    """Whether a video is scanned in full: a probe passed the gate, or nothing could be probed (no length)."""
    return F.coalesce(probe_max >= gate, F.lit(False)) | ((F.coalesce(n_probes, F.lit(0)) == 0) & (F.coalesce(seconds, F.lit(0)) == 0))


def json_body(reply: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


# --- arrays ---------------------------------------------------------------------------


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def first_maximum(a: Column) -> Column:
    """Index, from 0, of the first greatest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def ema(values: Column, alpha: float) -> Column:
    """Exponential moving average of an ordered array, seeded by its first element."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda e, x: F.when(e.isNull(), x.cast("double")).otherwise(x * alpha + e * (1 - alpha)))


def resampled(a: Column, length: int) -> Column:
    """Nearest elements at ``length`` even places, ends included."""
    if length == 1:
        return F.slice(a, 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(a, F.bround(i * (F.size(a) - 1) / (length - 1)).cast("int")))


def interleaved(n: Column, k: int, turn: Column, turns: int) -> Column:
    """Indices of k of n frames, shifted by the pass so that passes tile the gaps; all where n is at most k."""
    step = n / k
    shift = (turn - 1) * step / turns
    drawn = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(n - 1, F.bround(shift + i * step).cast("int")))
    return F.when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array_sort(F.array_distinct(drawn)))


def well_shaped(a: Column, rows: int, width: int) -> Column:
    """An array of ``rows`` arrays of ``width`` finite numbers."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(a) == rows) & F.forall(a, lambda v: (F.size(v) == width) & F.forall(v, finite)), F.lit(False))


# --- angles and boxes --------------------------------------------------------------------


def angle_gap(a: Column, b: Column) -> Column:
    """Difference of two angles, in [0, pi]."""
    import math

    d = F.pmod(F.abs(a - b), F.lit(2 * math.pi))
    return F.least(d, F.lit(2 * math.pi) - d)


def circular_mean(angle: Column) -> Column:
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def crop_side(width: Column, height: Column, grow: float = 1.5, least: float = 0.2) -> Column:
    return F.least(F.greatest(F.greatest(width, height) * grow, F.lit(least)), F.lit(1.0))


def iou(both: Column, either: Column) -> Column:
    """Intersection over union of counts; 1 for two empty sets."""
    return F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(1.0))


def scaled(side: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(side * factor).cast("int"))
