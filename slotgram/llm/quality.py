"""Quality rules: base counts, then distribution divergence.

A document's histogram of character classes, and of common words, is compared with the
reference of its language by Jensen-Shannon distance (base 2, square root).  References are
sums over all documents of a language that pass the base rules; they are a few numbers for
each language, however large the corpus.  A guard leaves short documents alone: a histogram
is only compared from a minimum number of words on.

Nulls: null text has no words and fails the base rules (n_words < 10).  A document of a null or
unlisted language is compared with each language's reference and judged by the nearest; it takes
no part in a reference.  A language in which no document passes has no reference, and rejects
nothing by distance.  Other columns are kept; those with the names of added ones are replaced
(``judged_rows`` keeps them in a struct).  Texts are processed in chunks of about a megabyte, whole
and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from slotgram.llm.common import Words, mix, table, text_chunks

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Least words for each comparison.
CLASS_GUARD, WORD_GUARD = 20, 60
#: A distance up to a + b / sqrt(n_words) is accepted: few words scatter more.
CLASS_LIMIT, WORD_LIMIT = (0.14, 1.5), (0.17, 1.2)

# Frequent function words of the four languages.
COMMON = {
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have an had they you were their one all we can her has there been if more when will would who so no".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux mais comme on ont cette ses être fait leur nous".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay".split(),
}
LANGS = sorted(COMMON)
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "other")


def _byte_classes() -> np.ndarray:
    of = np.full(256, CLASSES.index("other"), np.uint8)
    of[:32] = CLASSES.index("control")
    of[33:127] = CLASSES.index("symbol")
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (32, 9, 10, 11, 12, 13)), ("stop", b".,;:'\"()?-")):
        of[list(chars)] = CLASSES.index(name)
    of[128:192] = 255  # continuation bytes: their code point is counted at its first byte
    return of


_CLASS = _byte_classes()
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: For each byte its class; then the symbols that are counted by themselves, and what begins no code point.
MARK, INSIDE = len(CLASSES), len(CLASSES) + 1
_CODE = np.where(_CLASS == 255, INSIDE, np.where(_SYMBOL, MARK, _CLASS)).astype(np.int64)


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return Words(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, sum(map(len, raw)) + len(raw) - 1]), True).hashes


_WORDS = {k: _hash_words(v) for k, v in COMMON.items()}
_ALL = np.unique(np.concatenate(list(_WORDS.values())))
_MASKS = np.array([np.isin(_ALL, _WORDS[k]) for k in LANGS])


def of_language(common: np.ndarray, lang: int) -> np.ndarray:
    """Counts of the common words of one language, and of all other words in the last column."""
    mask = np.append(_MASKS[lang], False)
    out = np.where(mask, common, 0)
    out[:, -1] = common.sum(1) - out.sum(1)
    return out


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def histograms(text: np.ndarray, bins: np.ndarray, n: int, k: int) -> np.ndarray:
    """Counts of the ``bins`` (below k) of each of n texts, given each bin's text."""
    return np.bincount(text * k + bins, minlength=n * k).reshape(n, k)


def repeated_words(words: Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, words inside windows of k words found twice or more in that text."""
    at = words.whole(k)
    if not len(at):
        return np.zeros(len(words.count), np.int64)
    key = mix(words.grams(k)[at] + words.text_of()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return _per_text(np.cumsum(edge)[:-1] > 0, words.first)


def repeated_lines(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = np.zeros(len(offsets) - 1, np.int64)
    data = buf.tobytes()
    for i in range(len(found)):
        lines = [x for x in data[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        found[i] = len(lines) - len(set(lines))
    return found


def _measured(batch: pa.RecordBatch) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    langs = pc.fill_null(batch.column("lang"), "").to_pylist()
    for i, j, buf, offsets in text_chunks(batch):
        words = Words(buf, offsets)
        folded = Words(buf, offsets, True)
        lang = np.array([LANGS.index(x) if x in COMMON else len(LANGS) for x in langs[i:j]])
        place = np.searchsorted(_ALL, folded.hashes)
        place[place == len(_ALL)] = 0
        common = np.where(_ALL[place] == folded.hashes, place, len(_ALL)) if len(place) else place
        hist = histograms(words.text_of(), common, j - i, len(_ALL) + 1).astype(float)
        codes = histograms(np.repeat(np.arange(j - i), np.diff(offsets)), _CODE[buf], j - i, INSIDE + 1)
        marks = codes[:, MARK].copy()
        codes[:, CLASSES.index("symbol")] += marks
        classes = codes[:, :MARK].astype(float)
        n, repeats = words.count.astype(np.int64), repeated_words(words)
        yield i, j, {
            "lang": lang, "classes": classes, "common": hist, "n_words": n,
            "word_chars": codes[:, :MARK].sum(1) - codes[:, CLASSES.index("space")],
            "n_symbols": marks, "n_dup_lines": repeated_lines(buf, offsets), "n_repeat_words": repeats,
            "base_failed": (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n),
        }


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of counts; 0 where either side is empty."""
    empty = (p.sum(-1) == 0) | (q.sum(-1) == 0)
    p, q = p / np.maximum(p.sum(-1, keepdims=True), 1e-300), q / np.maximum(q.sum(-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)) / 2
    return np.where(empty, 0, np.sqrt(np.clip(d, 0, 1)))


def diverges(distance: np.ndarray, n: np.ndarray, guard: int, limit: tuple[float, float]) -> np.ndarray:
    return (n >= guard) & (distance > limit[0] + limit[1] / np.sqrt(np.maximum(n, 1)))


def references(docs: DataFrame) -> dict[str, np.ndarray]:
    """Class and word counts by language, over all its documents that pass the base rules.  Each
    partition sends at most one row per language and bin."""

    def sums(batches):
        n = len(CLASSES) + len(_ALL) + 1
        total = np.zeros((len(LANGS), n))
        for batch in batches:
            for _, _, x in _measured(batch):
                for k in range(len(LANGS)):
                    ok = ~x["base_failed"] & (x["lang"] == k)
                    total[k] += np.append(x["classes"][ok].sum(0), of_language(x["common"][ok], k).sum(0))
        lang, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(total[lang, bin_].astype(np.int64))], ["lang", "bin", "n"])

    rows = docs.select("lang", "text").mapInArrow(sums, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((len(LANGS), len(CLASSES) + len(_ALL) + 1))
    for lang, bin_, n in rows:
        total[lang, bin_] = n
    return {"classes": total[:, : len(CLASSES)], "common": total[:, len(CLASSES) :]}


def distances(x: dict[str, np.ndarray], reference: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Class and word distance of each text to its language's reference, or to the nearest one."""
    by = np.full((2, len(LANGS), len(x["lang"])), np.inf)
    for k in np.flatnonzero(reference["classes"].sum(1)):
        rows = np.flatnonzero((x["lang"] == k) | (x["lang"] == len(LANGS)))
        by[0, k, rows] = js_distance(x["classes"][rows], reference["classes"][k])
        by[1, k, rows] = js_distance(of_language(x["common"][rows], k), reference["common"][k])
    near = by.min(1)
    near[np.isinf(near)] = 0
    return near[0], near[1]


def judge_quality(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all; text and lang are needed) with n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance and kept."""
    reference = references(docs)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in (keep or docs.columns) if c not in {*added, "base_failed", "class_distance", "word_distance", "kept"}]
    docs = docs.select(*dict.fromkeys([*keep, "text", "lang"]))
    schema = StructType([*docs.select(*keep).schema.fields, *[StructField(c, LongType()) for c in added], StructField("base_failed", BooleanType())])
    schema = schema.add("class_distance", "double").add("word_distance", "double").add("kept", "boolean")

    def judged(batches):
        for batch in batches:
            for i, j, x in _measured(batch):
                by_class, by_word = distances(x, reference)
                ok = ~x["base_failed"] & ~diverges(by_class, x["n_words"], CLASS_GUARD, CLASS_LIMIT) & ~diverges(by_word, x["n_words"], WORD_GUARD, WORD_LIMIT)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(x[c].astype(np.int64)) for c in added] + [pa.array(y) for y in (x["base_failed"], by_class, by_word, ok)], [*keep, *added, "base_failed", "class_distance", "word_distance", "kept"])

    return docs.mapInArrow(judged, schema)


def judged_rows(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, so that no name can clash) and the judgement."""
    return judge_quality(docs.select(docs["lang"].alias("lang"), docs["text"].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row")), ["row"])


def query(spark, sf_dir) -> DataFrame:
    found = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return found.drop("class_distance", "word_distance")


def _sql() -> str:
    listed = ", ".join(f"('{k}', '{w}')" for k, ws in COMMON.items() for w in dict.fromkeys(ws))
    lower, stop = "[a-z]", r"[.,;:''\"()?-]"
    classes = {"lower": lower, "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": stop, "control": r"[\x00-\x08\x0E-\x1F]", "other": r"[^\x00-\x7E]"}
    each = ", ".join(f"{{'bin': '{k}', 'n': length(t) - length(regexp_replace(t, '{v}', '', 'g'))}}" for k, v in classes.items())
    distance = lambda part: f"""SELECT doc_id, min(d) AS d FROM (SELECT doc_id, l, sqrt(greatest(0, least(1, (sum(p * log2(p / ((p + coalesce(q, 0)) / 2)) + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) + 1 - coalesce(sum(q), 0)) / 2))) AS d
  FROM (SELECT doc_id, l, bin, n / sum(n) OVER (PARTITION BY doc_id, l) AS p FROM {part} WHERE n > 0) LEFT JOIN (SELECT l, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY l) AS q FROM {part} JOIN base USING (doc_id) WHERE NOT base_failed AND lang = l GROUP BY l, bin) USING (l, bin)
  WHERE l IN (SELECT lang FROM base WHERE NOT base_failed) GROUP BY doc_id, l) GROUP BY doc_id"""  # noqa: E731
    bound = lambda d, guard, limit: f"NOT (n_words >= {guard} AND coalesce({d}, 0) > {limit[0]} + {limit[1]} / sqrt(greatest(n_words, 1)))"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {REPEAT_WINDOW - 1}], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + {REPEAT_WINDOW})) AS pos FROM g JOIN (SELECT doc_id, w FROM g GROUP BY doc_id, w HAVING count(*) > 1) USING (doc_id, w)) GROUP BY doc_id),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM (
  SELECT doc_id, lang, ws, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d) LEFT JOIN rep USING (doc_id))),
common(l, w) AS (VALUES {listed}),
langs AS (SELECT DISTINCT l FROM common),
judged AS (SELECT doc_id, l FROM d JOIN langs ON lang = l OR lang IS NULL OR lang NOT IN (SELECT l FROM langs)),
c0 AS (SELECT doc_id, unnest([{each}], recursive := true) FROM d),
c1 AS (SELECT * FROM c0 UNION ALL SELECT doc_id, 'symbol', length(t) - sum(n) FROM c0 JOIN d USING (doc_id) GROUP BY doc_id, t),
classes AS (SELECT doc_id, l, bin, n FROM c1 JOIN judged USING (doc_id)),
words AS (SELECT x.doc_id, x.l, coalesce(common.w, '') AS bin, count(*) AS n FROM (SELECT doc_id, l, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM d JOIN judged USING (doc_id)) x LEFT JOIN common ON common.l = x.l AND common.w = x.w GROUP BY ALL),
by_class AS ({distance("classes")}),
by_word AS ({distance("words")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {bound("by_class.d", CLASS_GUARD, CLASS_LIMIT)} AND {bound("by_word.d", WORD_GUARD, WORD_LIMIT)} AS kept
FROM base LEFT JOIN by_class USING (doc_id) LEFT JOIN by_word USING (doc_id)
"""


SQL = _sql()
