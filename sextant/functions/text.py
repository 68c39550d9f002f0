"""Text expressions: identities, token sets, names that a question turns on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of texts that are taken out of a batch at once: as Python strings they need several times as many.
PART_BYTES = 2 << 20

#: White space as Unicode has it, for Java and RE2 alike.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: Words that need not occur in a passage, however they are written.
STOP_WORDS = tuple(
    sorted(
        set(
            """
            yes no not so also any all some these those there then than that this they them their we us our my me i you your it its
            who what when where which why how with will would should could can may might must shall were was is are be had has have
            do does did by but and or an a the to of on in at as for from if into out up down off about among until while during before after
            bi power azure microsoft fabric data ids id names name guides guide documentation documents document sections section fields field
            values value enables enabled enable creates created create configures configured configure configuration default uses use supports support
            settings setting options option modes mode types type items item services service features feature roles role users user files file tables table
            """.split()
        )
        - {"did"}
    )
)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(text), 256))


def passage_id(source_file: Column | str, char_offset: Column | str, char_length: Column | str) -> Column:
    """16 hex digits that stay with a place in a file, whatever the text there."""
    place = F.concat_ws("\x1f", _col(source_file), _col(char_offset).cast("string"), _col(char_length).cast("string"))
    return F.substring(F.sha2(place, 256), 1, 16)


def text_slice(text: Column | str, char_offset: Column | str, char_length: Column | str) -> Column:
    return F.substring(_col(text), _col(char_offset) + 1, _col(char_length))


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(_col(text)), SPACE), lambda x: x != "")


def trigrams(text: Column | str) -> Column:
    """Distinct runs of three tokens; null if there are fewer tokens."""

    def of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.concat_ws("\x1f", F.slice(t, i, 3)))
        return F.when(F.size(t) >= 3, F.array_distinct(grams))

    # as a variable of a lambda the tokens are split once, not once for each run
    return F.get(F.transform(F.array(tokens(text)), of), F.lit(0))


def hashed_trigrams(text: Column | str) -> Column:
    """``trigrams`` as 64-bit hashes, an eighth of the bytes; as sets they overlap alike."""
    return F.transform(trigrams(text), lambda g: F.xxhash64(g))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two trigram sets; 1 where either text is too short to tell."""
    a, b = _col(a), _col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


_QUOTED = r"""['"]([^'"]+)['"]"""


def names(question: Column | str) -> Column:
    """What must occur verbatim: quoted spans, then capitals-only words and words with digits, each once, in order."""
    q = F.coalesce(_col(question), F.lit(""))
    quoted = F.filter(F.transform(F.regexp_extract_all(q, F.lit(_QUOTED), 1), lambda x: F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")), lambda x: F.length(x) >= 3)
    words = F.regexp_extract_all(F.regexp_replace(q, _QUOTED, " "), F.lit("[A-Za-z][A-Za-z0-9-]*"), 0)
    stops = F.array(*(F.lit(w) for w in STOP_WORDS))
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ((w == F.upper(w)) | w.rlike("[0-9]")) & ~F.array_contains(stops, F.lower(w)))
    return F.array_distinct(F.concat(quoted, words))


def contains_name(text: Column | str, name: Column) -> Column:
    """Short capitals-only names as whole words, others as parts of words in any case."""
    text = _col(text)
    short = (F.length(name) <= 6) & (name == F.upper(name)) & (name != F.lower(name))
    word = F.concat(F.lit(r"(?U)\b"), F.regexp_replace(name, r"([^\p{L}\p{N}_])", r"\\$1"), F.lit(r"\b"))
    return F.when(short, F.rlike(text, word)).otherwise(F.contains(F.lower(text), F.lower(name)))


def missing_names(question: Column | str, text: Column | str) -> Column:
    text = F.coalesce(_col(text), F.lit(""))
    return F.filter(names(question), lambda n: ~contains_name(text, n))


def refusal(missing: Column | str) -> Column:
    """A note before the passages if names are missing, else an empty string."""
    m = _col(missing)
    listed = F.array_join(F.transform(m, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")
    return F.when(F.size(m) > 0, F.concat(F.lit("> No passage names "), listed, F.lit(". Say so instead of answering about something alike.\n"))).otherwise("")


def preview(text: Column | str, most: int = 280) -> Column:
    t = F.replace(F.regexp_replace(_col(text), f"^{SPACE}|{SPACE}$", ""), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def quoted_path(path: Column | str) -> Column:
    """Percent-encoded, segment by segment."""
    code = lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(F.split(_col(path), "/"), code), "/")


def lines_normalized(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "\r\n?", "\n")


def in_parts(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts in ``column`` have up to ``most`` bytes, or of one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, ends[lo] - sizes[lo] + (most or PART_BYTES), side="right"))
            hi = max(lo + 1, hi)
            yield batch.slice(lo, hi - lo)
            lo = hi
