"""Quality rules, line first.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go,
and a document that loses too many of its words that way is rejected, besides those that
fail the base rules on length and repetition.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least words of a document, the percentage of its words that may stand in repeated 3-word windows, and the share of its words that may go with failing lines.
LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 0.5
#: A sentence's last characters; separators of menus; phrases of boilerplate lines.
ENDS = ".!?…。！？"
CLOSERS = "\"'”’»)]"
SEPARATORS = "|›»•·"
PHRASES = (
    "accept cookies", "all rights reserved", "cookie policy", "cookies to", "enable javascript", "javascript is disabled", "lorem ipsum", "powered by", "privacy policy",
    "sign in to", "sign up for", "subscribe to our", "terms of service", "terms of use", "click here to", "share this article", "skip to content",
    "accepter les cookies", "politique de confidentialité", "tous droits réservés", "mentions légales", "partager cet article",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "artikel teilen",
    "aceptar las cookies", "política de privacidad", "política de cookies", "todos los derechos reservados", "compartir este artículo",
)

BARS = [c.encode() for c in SEPARATORS]


def line_fails(line: str, words: list[bytes]) -> str:
    """The rule that a line with words fails: navigation, boilerplate, symbols, shouting, punctuation, or '' for none."""
    n = len(words)
    bars = sum(map(words.count, BARS))
    if bars >= 3 and 5 * bars >= n:
        return "navigation"
    if n <= 40:
        low = line.lower()
        if any(p in low for p in PHRASES):
            return "boilerplate"
    if 2 * sum(map(line.count, "#*$%&|<>")) > n:
        return "symbols"
    shouts = line.count("!")
    if shouts > 2 and 2 * shouts > n:
        return "shouting"
    end = line.rstrip(" \t\n\x0b\x0c\r" + CLOSERS)[-1:]
    return "" if end and end in ENDS else "punctuation"


def repeated_words(words: list) -> int:
    """Words within 3-word windows that are found twice or more among `words`."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, until)
            until = i + 3
    return total


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept, cleaned text."""
    text = text or ""
    # bytes.split() parts at the bytes 9 to 13 and 32 alone, which are no part of other code points
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen, dup, lost, stay = set(), 0, 0, []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            stay.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_fails(line, own):
            lost += len(own)
        else:
            stay.append(line)
    again = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
    cleaned = text if not lost else "\n".join(stay)
    return n, word_chars, sum(map(text.count, "#*$%&|<>")), dup, again, failed, lost, not failed and lost <= MOST_LOST * n, cleaned


FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("lost_words", pa.int64()), ("kept", pa.bool_()), ("cleaned", pa.string()),
]
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_words long, kept boolean, cleaned string"


def _judged(docs: DataFrame, text_col: str, cleaned: bool) -> DataFrame:
    """_row, the columns of `docs` but the text as one struct, then the verdict's columns (see `judge`)."""
    fields = FIELDS if cleaned else FIELDS[:-1]
    names = [f[0] for f in fields]
    keep = [c for c in docs.columns if c != text_col]
    put = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_none"))
    source = docs.select(put.alias("_row"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = list(zip(*map(judge, part.column(1).to_pylist())))
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, t) for v, (_, t) in zip(rows, fields)]], names=["_row", *names])

    ddl = DDL if cleaned else DDL.removesuffix(", cleaned string")
    return source.mapInArrow(run, f"_row {source.schema['_row'].dataType.simpleString()}, {ddl}")


def assess(docs: DataFrame, text_col: str = "text", cleaned: bool = True) -> DataFrame:
    """All columns of `docs` but the text, then the verdict's columns (see `judge`).

    A null or empty text has no words and fails; whole texts are read, each on its own, so
    ties, repeated rows, ids and further columns make no difference, and an empty table
    gives an empty result. A column of `docs` with the name of one of the verdict's is
    left out in favour of the verdict's.
    """
    names = [f[0] for f in (FIELDS if cleaned else FIELDS[:-1])]
    keep = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != text_col and c not in names]
    return _judged(docs, text_col, cleaned).select(*keep, *names)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, without their failing lines.

    Columns are those of `docs` with their values, whatever their names, but for the text
    and n_chars, which is set anew if there is such a column. Null and empty texts go.
    """
    made = {text_col: F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    out = _judged(docs, text_col, True).where("kept")
    return out.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
