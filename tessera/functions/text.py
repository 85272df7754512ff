"""Scalar functions on text, JVM-side but for SimHash."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.schemas import EVENT_MENTION, ZERO, ZERO_SIGN
from tessera.scratch import ship

ship(__name__)

SENTENCE = "[^。！？!?；;]+[。！？!?；;]?"
#: One of Unicode's white space; Java's class leaves the four separators of ASCII out.
SPACE = r"(?U)[\s\x1C-\x1F]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def strip(s: Column | str) -> Column:
    """Trim Unicode white space."""
    return F.regexp_replace(col(s), rf"(?U)^{SPACE[4:]}+|{SPACE[4:]}+$", "")


def normalize_space(s: Column | str) -> Column:
    """Delete all Unicode white space."""
    return F.regexp_replace(col(s), f"{SPACE}+", "")


def sanitize_doc_id(s: Column | str) -> Column:
    """Trim; blank becomes UNKNOWN_DOC; white space, parentheses and semicolons become underscores."""
    t = strip(F.coalesce(col(s).cast("string"), F.lit("")))
    t = F.when(t == "", F.lit("UNKNOWN_DOC")).otherwise(t)
    return F.translate(F.regexp_replace(t, f"{SPACE}+", "_"), "();", "___")


def sentences_of(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(SENTENCE), F.lit(0))


def first_sentence(text: Column | str, sentences: Column | str | None = None, width: int = 180) -> Column:
    """The first listed sentence, else the text up to its first sentence end; at most width characters."""
    own = F.get(F.split(col(text), "(?<=[。！？!?])", 2), F.lit(0))
    return F.substring(own if sentences is None else F.coalesce(F.get(col(sentences), F.lit(0)), own), 1, width)


def char_tokens(sentence: Column | str, skip_space: bool = True) -> Column:
    """Characters with their offsets: array of (char_index, token)."""
    chars = F.transform(F.split(col(sentence), ""), lambda c, i: F.struct(i.alias("char_index"), c.alias("token")))
    keep = F.filter(chars, lambda c: c["token"] != "")
    return F.filter(keep, lambda c: ~c["token"].rlike(SPACE)) if skip_space else keep


def ngrams(s: Column | str, n: int) -> Column:
    """The distinct character n-grams without white space; none if shorter than n. Characters are split once: substring would start over for each gram."""

    def cut(c: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(F.get(c, i + k) for k in range(n))))
        return F.when(F.size(c) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(normalize_space(s), ""), lambda c: c != ""), cut)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def stable_hash64(s: Column) -> Column:
    """The first 8 bytes of MD5 as a little-endian 64-bit value, in two's complement."""
    hexed = F.md5(s.cast("binary"))
    turned = F.concat(*(F.substring(hexed, 15 - 2 * i, 2) for i in range(8)))
    return F.conv(turned, 16, -10).cast("long")


@F.pandas_udf(LongType())
def _simhash3(texts: pd.Series) -> pd.Series:
    digests: dict[int, bytes] = {}

    def some(few: list[str]) -> np.ndarray:
        """Signatures of a few texts: their distinct grams are numbered once, counted by text and hashed once."""
        points = np.frombuffer("".join(few).encode("utf-32-le"), dtype=np.uint32)
        length = np.array([len(x) for x in few])
        starts, many = np.cumsum(length) - length, np.maximum(length - 2, 0)
        out = np.zeros(len(few), dtype=np.int64)
        if not many.any():
            return out
        own = np.repeat(np.arange(len(few)), many)
        at = np.arange(len(own)) + np.repeat(starts - (np.cumsum(many) - many), many)
        letters, p = np.unique(points, return_inverse=True)
        n = len(letters)
        grams = (p[at] * n + p[at + 1]) * n + p[at + 2]
        if n**3 <= 1 << 22:
            distinct = np.flatnonzero(np.bincount(grams, minlength=1))
            place = np.zeros(n**3, dtype=np.int64)
            place[distinct] = np.arange(len(distinct))
            number = place[grams]
        else:
            distinct, number = np.unique(grams, return_inverse=True)
        codes = (letters[distinct // (n * n)].astype(np.int64) << 42) | (letters[distinct // n % n].astype(np.int64) << 21) | letters[distinct % n]
        for c in codes.tolist():
            if c not in digests:
                digests[c] = hashlib.md5((chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF)).encode()).digest()[:8]
        raw = np.frombuffer(b"".join(digests[c] for c in codes.tolist()), dtype=np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64) * 2 - 1
        if len(digests) > 1 << 18:
            digests.clear()
        wide = max(1, (1 << 22) // len(distinct))
        for a in range(0, len(few), wide):
            b = min(len(few), a + wide)
            lo, hi = np.searchsorted(own, [a, b])
            times = np.bincount((own[lo:hi] - a) * len(distinct) + number[lo:hi], minlength=(b - a) * len(distinct)).reshape(b - a, -1)
            out[a:b] = np.packbits(times.astype(np.float64) @ bits > 0, axis=1, bitorder="little").view("<i8")[:, 0]
        return out

    out, few, held = [np.zeros(0, dtype=np.int64)], [], 0
    for t in texts:
        few.append(t or "")
        held += len(few[-1])
        if len(few) == 256 or held > 1 << 20:
            out.append(some(few))
            few, held = [], 0
    return pd.Series(np.concatenate([*out, some(few)] if few else out), index=texts.index)


def simhash(s: Column | str) -> Column:
    """A 64-bit SimHash over all 3-grams, repeats counted: a bit is set where more hashes have it than not. The 64 votes per gram run in numpy, a batch at a time."""
    return _simhash3(F.coalesce(normalize_space(s), F.lit("")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def strip_code_fences(s: Column | str) -> Column:
    """The bodies of fenced blocks joined by line breaks, or the input without any."""
    return let(
        F.regexp_extract_all(col(s), F.lit(r"```(?:json)?\s*([\s\S]*?)\s*```"), F.lit(1)),
        lambda m: F.when(F.size(m) > 0, F.array_join(m, "\n")).otherwise(col(s)),
    )


def sanitize_json_like(s: Column | str) -> Column:
    """Fences off, curly quotes and wide colons to ASCII, Python literals to JSON's, trailing commas off, trimmed."""
    t = F.translate(strip_code_fences(s), "“”‘’：", '"""":')
    for word, json in (("True", "true"), ("False", "false"), ("None", "null")):
        t = F.regexp_replace(t, rf"\b{word}\b", json)
    return strip(F.regexp_replace(t, r",(\s*[\]}])", "$1"))


def balanced_object(s: Column | str) -> Column:
    """From the first { to the } that balances it, counting braces wherever they stand; null without one."""

    def scan(text: Column) -> Column:
        start = F.instr(text, "{")
        state = F.aggregate(
            F.split(F.substring(text, start, F.length(text)), ""),
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")),
            lambda a, c: F.struct(
                (a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
                (a["at"] + F.length(c)).alias("at"),
                F.when((a["end"] == 0) & (c == "}") & (a["depth"] == 1), a["at"] + 1).otherwise(a["end"]).alias("end"),
            ),
        )
        return F.when(start > 0, let(state, lambda x: F.when(x["end"] > 0, F.substring(text, start, x["end"]))))

    return let(strip(s), scan)


def parse_object(s: Column | str) -> Column:
    """The JSON object in lenient text as canonical JSON text; null if there is none. Only objects count."""

    def obj(x: Column) -> Column:
        return F.when(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.to_json(F.try_parse_json(x)))

    own = balanced_object(s)
    return F.coalesce(obj(own), obj(sanitize_json_like(own)), obj(sanitize_json_like(strip(s))))


#: Deictic prefixes in the order in which they are tried; the first that fits is taken off.
DEICTIC = (
    "这项", "这种", "这位", "这一", "这个", "这些", "这", "此", "该", "该项", "该举措", "该措施", "该工程", "该决定", "该工作", "该项目", "上述", "上述措施", "上述行动",
)


def normalize_head(s: Column | str, prefixes: tuple[str, ...] = DEICTIC) -> Column:
    return F.regexp_replace(strip(s), f"^(?:{'|'.join(prefixes)})", "")


#: What separates the parts of a topic; the second has the range of the first form's class in it.
TOPIC_MARKS, TOPIC_MARKS_RANGE = r"[：:|｜，、。；;,.!！?？\-—]+", r"[：:|｜，、。；;,.!！?？\\-—]+"


def topic_signature(s: Column | str, marks: str = TOPIC_MARKS) -> Column:
    t = F.regexp_replace(normalize_space(F.lower(col(s))), marks, "_")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(t, "_"), lambda x: x != ""))), "|")


def topic_brief(domain: Column, topic: Column, action: Column, conflict: Column, evidence: Column) -> Column:
    return F.concat(domain, F.lit("｜"), topic, F.lit("｜"), action, F.lit("｜关注："), conflict, F.lit("｜证据："), evidence)


def replace_terms(s: Column | str, terms: dict[str, str]) -> Column:
    """Replace terms one after the other."""
    out = col(s)
    for old, new in terms.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def fill_prompt(template: Column | str, values: dict[str, Column]) -> Column:
    """Replace {name} by each value."""
    out = col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def prompt_hash(prompt: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(prompt).cast("binary"), 256))


def norm_text(s: Column | str) -> Column:
    return F.lower(normalize_space(s))


def is_zero_mention(text: Column, mention_type: Column) -> Column:
    """Text is or begins with the zero sign, or the type says so."""
    return F.coalesce(strip(text).startswith(ZERO_SIGN), F.lit(False)) | F.coalesce(mention_type == ZERO, F.lit(False))


def is_blank(s: Column | str) -> Column:
    return col(s).isNull() | F.lower(strip(col(s).cast("string"))).isin("", "nan", "none", "null", "na")


def safe_int(s: Column | str) -> Column:
    """Text that reads as a number, truncated; null otherwise, for booleans and for what no 32-bit integer holds."""
    x = strip(col(s).cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 2147483648.0), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("int"))


def yes(s: Column | str) -> Column:
    return F.coalesce(F.lower(strip(col(s).cast("string"))).isin("1", "true", "yes"), F.lit(False))


def as_bool(s: Column | str) -> Column:
    """Like yes, but what is neither a true nor a false word raises."""
    t = F.lower(strip(col(s).cast("string")))
    return (
        F.when(t.isin("1", "true", "yes", "y", "t"), F.lit(True))
        .when(t.isin("0", "false", "no", "n", "f", ""), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(t, F.lit("null")))).cast("boolean"))
    )


def inclusive_end(char_end: Column, mode: str) -> Column:
    return char_end - 1 if mode == "exclusive" else char_end


def mention_text_check(sentence: Column, text: Column, start: Column, end: Column) -> Column:
    """ok, space_only (equal but for white space), mismatch, or bad_char_offset; end inclusive."""
    cut = F.substring(sentence, start + 1, end - start + 1)
    return (
        F.when(start.isNull() | end.isNull() | (start < 0) | (end < start) | (end >= F.length(sentence)), "bad_char_offset")
        .when(cut == text, "ok")
        .when(normalize_space(cut) == normalize_space(text), "space_only")
        .otherwise("mismatch")
    )


def sentence_index(sentence_id: Column, n: Column, allow_zero_based: bool = True) -> Column:
    """(index, issue): 1-based numbers to 0-based; 0 is taken as a 0-based number with a warning, if allowed."""
    i = safe_int(sentence_id)
    return (
        F.when(i.isNull(), F.struct(F.lit(None).cast("int").alias("index"), F.lit("sentence_id_not_int").alias("issue")))
        .when((i >= 1) & (i <= n), F.struct((i - 1).alias("index"), F.lit(None).cast("string").alias("issue")))
        .when(
            F.lit(allow_zero_based) & (i == 0) & (n > 0),
            F.struct(i.alias("index"), F.lit("sentence_id_zero_based").alias("issue")),
        )
        .otherwise(F.struct(F.lit(None).cast("int").alias("index"), F.lit("sentence_id_out_of_range").alias("issue")))
    )


#: Year rules and sensitive strings.
YEAR_START = r"^\s*20(25|26|27|28|29)\s*年"
YEAR_BEFORE_2025 = r"20(0[0-9]|1[0-9]|2[0-4])\s*年"
SENSITIVE_PATH = r"/work/home/|/root/|\.ai_user_info|[A-Za-z]:\\"
SENSITIVE_KEY = r"(?i)api[_-]?key\s*[:=]|secret[_-]?key\s*[:=]|access[_-]?token\s*[:=]|refresh[_-]?token\s*[:=]|bearer\s+[A-Za-z0-9._-]+|sk-[A-Za-z0-9_-]{10,}"


def distance_bucket(d: Column) -> Column:
    return F.when(d == 0, "0").when(d == 1, "1").when(d <= 3, "2-3").otherwise("4+")


def label_map(s: Column | str, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[col(s)]


def utc_now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def fixed(x: Column | str, digits: int) -> Column:
    """A number with so many decimals, rounded half to even on its exact binary value; nan and inf in small letters."""
    c = col(x).cast("double")
    text = F.call_function("format_number", c, F.lit("0." + "0" * digits if digits else "0"))
    return F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(text)


def event_end(start: Column | str, trigger: Column | str) -> Column:
    """The last character of a trigger."""
    return col(start) + F.length(col(trigger)) - 1


def is_explicit_event(mention_type: Column | str, semantics: Column | str) -> Column:
    return F.coalesce((col(mention_type) == EVENT_MENTION) & (col(semantics) == "EVENT"), F.lit(False))
