"""Spelling variants: words one edit apart, grouped under their most frequent form.

A word's letters are a binary vector with one place for each letter and occurrence. One edit
changes at most two places if it replaces a letter, and one if it inserts or deletes one. The
letters are dealt into `PARTS` classes. Two vectors of words of one length agree in all but two
classes at most, words of neighbouring lengths in all but one: a signature is what is left of
a word when two classes (or one) are left out, for every choice. One edit also leaves one half
of the shorter word as it is, at its beginning or at its end, so a signature names that half
too, and words with the same letters in another order don't meet. Words with an equal
signature are joined, and each pair is verified by its edit distance inside the join.

Words are maximal runs of `[A-Za-zÀ-ÿ]`, A-Z in lower case. They are counted within
a task before anything is shuffled. A NULL text has no words, a NULL id counts as empty text,
repeated rows count each, an empty table gives no rows, and other columns are not read. Texts
are read whole; a task holds one text and at most `HELD` counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casestats.llm.common import LOWER, UPPER, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans(UPPER, LOWER)
MIN_LENGTH, MIN_COUNT = 5, 3

# Letters by how often they occur in the languages of the corpus, dealt in turn to the classes.
BY_USE = "etaoinshrdlcumwfgypbvkjxqz"
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
PARTS = 4

HELD = 300_000
TASK_WORDS = 20_000

# Which of a document's words is misspelt, and where.
Change = Callable[[str, str], str]


def misspelt(doc_id: str, run: str, every: int = 97) -> str:
    """`run`, or in one of `every` cases `run` without one of its letters."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame, change: Change | None = None, min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = Counter(RUN.findall((text.as_py() or "").translate(FOLD)))
                name = doc_id.as_py() or ""
                for run, n in own.items():
                    word = change(name, run) if change else run
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD:
                    yield _batch(held)
                    held.clear()
        yield _batch(held)

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (
        named.mapInArrow(counted, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def _batch(held: Counter[str]) -> pa.RecordBatch:
    columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n"])


def letter_classes(parts: int = PARTS) -> list[str]:
    return [BY_USE[k::parts] + ACCENTED[k::parts] for k in range(parts)]


def _left(word: Column, dropped: str) -> Column:
    """The letters of a word in order, but for the dropped ones."""
    kept = F.translate(word, dropped, "")
    return F.array_join(F.array_sort(F.split(kept, "")), "")


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, side, signature), one row for each choice of classes and each half.

    `side` says what a word meets: 0 words as long as itself, 1 longer ones, 2 shorter ones.
    """
    word, size = F.col("word"), F.length("word")
    classes = letter_classes(parts)
    every = []
    for side, left_out in ((0, 2), (1, 1), (2, 1)):
        shorter = size - 1 if side == 2 else size
        half = F.floor(shorter / 2).cast("int")
        halves = (word.substr(F.lit(1), half), word.substr(size - half + 1, half))
        for choice in combinations(range(parts), left_out):
            left = _left(word, "".join(classes[k] for k in choice))
            name = "".join(map(str, choice))
            for end, kept in zip("<>", halves, strict=True):
                key = F.xxhash64(F.lit(name + end), shorter, kept, left)
                every.append(F.struct(F.lit(side).alias("side"), key.alias("signature")))
    return words.select("word", "n", F.inline(F.array(*every)))


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, na, b, nb): pairs of words one edit apart, each once."""
    signed = stage(signatures(words, parts), "signatures")
    a, b = signed.alias("a"), signed.alias("b")
    equal = (F.col("a.side") == 0) & (F.col("b.side") == 0) & (F.col("a.word") < F.col("b.word"))
    longer = (F.col("a.side") == 1) & (F.col("b.side") == 2)
    one_edit = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    on = (F.col("a.signature") == F.col("b.signature")) & (equal | longer) & one_edit
    return (
        a.filter("side < 2")
        .join(b.filter("side <> 1"), on)
        .select(
            F.col("a.word").alias("a"), F.col("a.n").alias("na"),
            F.col("b.word").alias("b"), F.col("b.n").alias("nb"),
        )
        .distinct()
    )


def group_variants(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n for (word, n).

    The form is the most frequent near word (the first in code-point order among equals), if
    at least twice as frequent as the word; the root is the last word on the way from form to
    form.
    """
    words = stage(words, "words")
    # Words are few bytes but make many signatures: small tasks, however few files there are.
    dealt = words.repartition(1 + words.count() // TASK_WORDS)
    pairs = near_words(dealt, parts)
    both = pairs.select("a", "na", "b", "nb").union(pairs.select("b", "nb", "a", "na"))
    near = (
        both.groupBy(F.col("a").alias("word"), F.col("na").alias("n"))
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct(F.negative("nb").alias("minus"), F.col("b").alias("form"))).alias("best"),
        )
        .select("word", "n", "n_near", "best.form", F.negative("best.minus").alias("form_n"))
    )
    near = stage(near, "near")
    formed = near.filter(F.col("form_n") >= 2 * F.col("n"))
    roots = follow(formed.select("word", "form"), words)
    counted = near.select("word", "n_near")
    forms = formed.select("word", "form", "form_n")
    return (
        words.join(counted, "word", "left")
        .join(forms, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )


def follow(forms: DataFrame, words: DataFrame) -> DataFrame:
    """(word, root) of the words with a form.

    Each step at least doubles the count, so a way is no longer than the logarithm of the
    greatest one. Ways double their length each round.
    """
    most = words.agg(F.max("n")).first()[0] or 1
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most.bit_length().bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stage(
            roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
            "roots",
        )
    return roots


__all__ = ["count_words", "group_variants", "misspelt", "near_words", "signatures"]
