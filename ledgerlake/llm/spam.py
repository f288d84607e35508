"""Keyword-stuffed pages and link lists.

Method: every text is cut into blocks of whole pieces (sentences or lines). A block's deflate
ratio is measured twice, on its characters (phrases said again and again) and on its token
shapes (links, tags, codes, names and long words each as one symbol, so a list of different links
or names is as redundant as one repeated phrase). Both are normalised by the corpus median of
sentence blocks of the same language and length; a block far below it is extremely redundant.
Redundant blocks are confirmed by low sentence-punctuation density: a sentence mark vouches for
the few words before it, and what no mark vouches for, or what only says again words or sentences
said before, is loose, unless it is a row of an exhibit list or of figures. A text is spam if loose
pieces in redundant blocks make up more than half of it.

Nothing here knows a language: sentences are told by their marks, and shapes keep only short
lower-case words, which are the varied glue of prose in every script with two cases.

The norm is the median of sentence blocks only, equal blocks counted once, so that spam does not
set its own norm however much of a language it makes up. It is drawn towards the whole corpus'
median, and that towards fixed usual ratios, by the number of blocks: one formula for every count.

Scale: one pass over the texts; the second step reads the blocks' few numbers, not the texts. The
medians are one row per language and length class (at most 677 x 3 rows), broadcast; equal blocks
are made one by a shuffle of their few numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.session import cut, spread

BLOCK_CHARS = 320
#: A piece of more words is cut into parts of so many.
LONG_WORDS, PART_WORDS = 24, 12
#: A sentence mark vouches for so many words before it.
VOUCHED_WORDS = 24
#: A piece of fewer words goes with its neighbours.
SHORT_WORDS = 6
#: A block is redundant if its ratio is below this share of the median for its language and length.
REDUNDANT_BELOW = 0.85
#: Ratios of sentences by length class, where the corpus has too few of its own; they weigh as so many blocks.
USUAL = {"raw": (0.80, 0.72, 0.67), "shape": (0.33, 0.30, 0.27)}
USUAL_BLOCKS = 100
#: No norm lies below this share of the usual ratio.
LEAST_SHARE = 0.9
#: Lower-case words up to so many letters keep their shape; words of so many or more tell what a sentence is about.
GLUE_LETTERS = 4
#: A sentence's longer words repeat no more than this: so many are distinct, and no one makes up so many.
DISTINCT_SHARE, TOP_SHARE = 0.67, 0.4

# Spans end at the next mark of their own kind, so no text takes quadratic time.
_LINK = re.compile(r"(?<![\w./-])(?:(?:https?://|www\.)\S++|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,12}(?:/\S*+|\b\.html?\b\S*+))", re.I)
_ANCHOR = re.compile(r"<a\b[^<>]*+>[^<]*+</a>|\[[^\[\]\n]*+\]\([^()\s]++\)", re.I)
_TAG = re.compile(r"(?<!\w)[#@][^\W_][\w-]*|(?<!\w)\$[A-Z]{1,6}\b")
_TICKER = re.compile(r"\$[A-Z]")
_TOKEN = re.compile(r"[\x01\x02]|\w+|[^\w\s]")
#: Lower-case letters of the Latin, Greek and Cyrillic scripts.
_LOWER = "a-zß-öø-ÿα-ώа-џ"
_SPLIT = re.compile(rf"(?<=[.!?…])\s+(?=[^\W\d_{_LOWER}]|[\"'(\[<#¿¡«„“])|(?<=[。！？])|\n+")
_MARKS, _CLOSERS = frozenset(".!?…。！？।؟"), frozenset("\"'”’»)]")
_MARK = re.compile(r"[.!?…。！？।؟][\"'”’»)\]]*\s*$")
_ITEM = rf"(?:{_ANCHOR.pattern}|{_LINK.pattern}|{_TAG.pattern})"
_RUN = re.compile(rf"({_ITEM}(?:[\s|,;>*–-]+{_ITEM})+)", re.I)
_LISTED = re.compile(r"\s*(?:[-*•]\s*)?(?:\d{1,3}\.\d{1,3}|[ivx\d]{1,3}\.|\([ivx\d]{1,4}\))\s+\S")
_FIGURE = re.compile(r"[$€£]?\(?\d[\d.,]*\)?%?")
_HAS_DIGIT = re.compile(r"\d")

BLOCK_SCHEMA = "doc_id long, lang string, size int, raw double, shape double, loose int, chars int"


def _shortened(text: str, start: int, end: int) -> bool:
    """Whether the text ends, at ``end``, in a shortened word: initials, or a short capitalised word with a full stop."""
    at = max(start, text.rfind(" ", start, end) + 1, end - 12)
    if end - at > 5 and text.find(".", at, end - 1) < 0:
        return False
    word = text[at:end].split()[-1:]
    return bool(word) and word[0][-1] == "." and (word[0].count(".") > 1 or (len(word[0]) <= 5 and word[0][0].isupper()))


def _sentences(text: str) -> Iterator[tuple[str, bool]]:
    """Stretches up to a sentence mark or line end, and whether they end in a mark."""
    text, start = text.rstrip(), 0
    for m in _SPLIT.finditer(text):
        at, last = m.start(), text[m.start() - 1]
        short = last == "." and at > start and _shortened(text, start, at)
        if short and "\n" not in m.group():
            continue
        yield text[start:at], not short and at > start and (last in _MARKS or (last in _CLOSERS and _ends_sentence(text, start, at)))
        start = m.end()
    yield text[start:], _ends_sentence(text, start, len(text))


def _ends_sentence(text: str, start: int, end: int) -> bool:
    return _MARK.search(text, max(start, end - 6), end) is not None and not _shortened(text, start, end)


def has_links(text: str) -> bool:
    """Whether a text may hold links, anchors or tags at all."""
    return "#" in text or "@" in text or "/" in text or "](" in text or "www." in text or ".htm" in text or ("$" in text and _TICKER.search(text) is not None)


def pieces(text: str) -> list[tuple[str, bool]]:
    """Sentences, or lines where lines end before a sentence does, and whether a mark vouches for each.

    Runs of links or tags stand alone, and what goes on for long without an end is cut into parts
    of a few words, so that a sentence set into a run does not hide it.
    """
    out: list[tuple[str, bool]] = []
    linked = has_links(text)
    for piece, ended in _sentences(text):
        runs = _RUN.split(piece) if linked and has_links(piece) else (piece,)
        for k, part in enumerate(runs):
            words = part.split()
            marked = ended and k + 1 == len(runs)
            if len(words) <= LONG_WORDS:
                if words:
                    part = part.strip()
                    out += [(part, marked)] if len(part) <= BLOCK_CHARS else [(q, marked) for q in _even(part)]
            else:
                for i in range(0, len(words), PART_WORDS):
                    near = marked and len(words) - i <= VOUCHED_WORDS
                    out += [(q, near) for q in _even(" ".join(words[i : i + PART_WORDS]))]
    return out


def masked(piece: str) -> str:
    """The piece with each link as one mark and each tag as another."""
    s = piece
    if "<" in s or "](" in s:
        s = _ANCHOR.sub(" \x01 ", s)
    if "/" in s or "www." in s or ".htm" in s:
        s = _LINK.sub(" \x01 ", s)
    if "#" in s or "@" in s or "$" in s:
        s = _TAG.sub(" \x02 ", s)
    return s


@lru_cache(maxsize=1 << 16)
def _shape(token: str) -> str:
    if token.isalpha():
        if token.islower():
            return token if len(token) <= GLUE_LETTERS else "x"
        if token.isupper():
            return "A"
        return "X" if token[:1].isupper() else token  # scripts of one case keep their words
    if token.isdigit():
        return "9"
    return {"\x01": "L", "\x02": "H"}.get(token, "C" if len(token) > 1 else token)


def shapes(mask: str) -> tuple[list[str], list[str]]:
    """Tokens of a masked piece, and their shapes: short lower-case words and marks as they are, all else by kind."""
    tokens = _TOKEN.findall(mask)
    return tokens, list(map(_shape, tokens))


def shape_of(piece: str) -> str:
    return " ".join(shapes(masked(piece))[1])


def is_loose(piece: str, vouched: bool | None = None) -> bool:
    """Neither a sentence nor a row of an exhibit list or of figures."""
    mask = masked(piece)
    return _is_loose(piece, mask, shapes(mask)[0], _ends_sentence(piece, 0, len(piece)) if vouched is None else vouched)


def _is_loose(piece: str, mask: str, tokens: list[str], vouched: bool) -> bool:
    if mask is not piece and len(mask.replace("\x01", "").replace("\x02", "")) < 0.6 * len(piece) and sum(map(str.isalpha, tokens)) < 8:
        return True
    if _LISTED.match(piece):
        return False
    if vouched and not _repeats(tokens):
        return False
    if not _HAS_DIGIT.search(piece):
        return True
    parts = piece.split()
    return sum(map(bool, map(_FIGURE.fullmatch, parts))) < 0.4 * len(parts)


def _repeats(tokens: list[str]) -> bool:
    """Whether a sentence says the same longer words again and again."""
    content = [t for t in tokens if len(t) >= GLUE_LETTERS]
    if len(content) < 3:
        return False
    content[0] = content[0].lower()  # the capital of a sentence's beginning
    own = set(content)
    if len(own) == len(content):
        return False
    return len(own) <= DISTINCT_SHARE * len(content) or max(map(content.count, own)) >= TOP_SHARE * len(content)


def ratio(text: str, of: int | None = None) -> float:
    """Deflated bytes of ``text`` by its own bytes, or by ``of`` bytes it stands for."""
    data = text.encode("utf-8", "replace")
    z = zlib.compressobj(6, zlib.DEFLATED, -12, 4)  # a window above any block's length, small tables
    return (len(z.compress(data)) + len(z.flush())) / max(1, of or len(data))


def blocks(text: str) -> list[tuple[int, float, float, int]]:
    """(chars, ratio of the text, ratio of the shapes, loose chars) of each block of whole pieces.

    Loose pieces and sentences fill blocks of their own, so that a few sentences set into a list
    do not hide how redundant the list is. A sentence said again in the same text is loose.
    """
    parts, marks, kinds = [], [], []
    said: set[str] = set()
    linked = has_links(text)
    for part, vouched in pieces(text):
        mask = masked(part) if linked else part
        tokens = _TOKEN.findall(mask)
        if vouched:
            key = part.lower()
            vouched = key not in said
            said.add(key)
        parts.append(part)
        kinds.append(" ".join(map(_shape, tokens)))
        marks.append(_is_loose(part, mask, tokens, vouched))
    for i in range(1, len(parts)) if any(marks) else ():
        if not marks[i] and marks[i - 1] and (i + 1 == len(parts) or marks[i + 1]) and parts[i].count(" ") < SHORT_WORDS - 1 and not _LISTED.match(parts[i]):
            marks[i] = True
    out: list[tuple[int, float, float, int]] = []
    for mark in (True, False):
        held: list[int] = []
        size, before = 0, len(out)
        own = [i for i, m in enumerate(marks) if m == mark]
        for k, i in enumerate(own):
            part = parts[i]
            held.append(i)
            size += len(part)
            last = k + 1 == len(own)
            if last and size < BLOCK_CHARS // 3 and len(out) > before:  # too short an end for a ratio of its own
                c, raw, shape, loose = out[-1]
                out[-1] = (c + size, raw, shape, loose + size * mark)
            elif last or size >= BLOCK_CHARS:
                block = "\n".join([parts[h] for h in held])
                out.append((size, ratio(block), ratio("\n".join([kinds[h] for h in held]), len(block)), size * mark))
                held, size = [], 0
    return out
def _even(piece: str) -> list[str]:
    if len(piece) <= BLOCK_CHARS:
        return [piece]
    out, at = [], 0
    while at < len(piece):
        end = at + BLOCK_CHARS
        if end < len(piece):
            gap = piece.find(" ", end)
            end = gap if 0 <= gap < end + BLOCK_CHARS else end
        out.append(piece[at:end].strip())
        at = end
    return [p for p in out if p]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    for pdf in batches:
        rows = [
            (int(i), lang, min(2, chars // 160), raw, shape, loose, chars)
            for i, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True)
            if isinstance(text, str)
            for chars, raw, shape, loose in blocks(text)
        ]
        yield pd.DataFrame(rows, columns=columns)


def language(c: Column) -> Column:
    """Two-letter code of an untidy language mark; ``und`` when there is none."""
    code = F.regexp_extract(F.lower(F.btrim(c)), r"^([a-z]{2})(?:$|[-_])", 1)
    return F.when(code != "", code).otherwise("und")


def _norms(measured: DataFrame) -> DataFrame:
    """norm_raw and norm_shape of each language and length class, from blocks of sentences."""
    sentences = F.col("loose") == 0
    prose = measured.groupBy("lang", "size", "chars", "loose", "raw", "shape").agg(F.lit(1).alias("one"))  # copies count once
    own = prose.groupBy("lang", "size").agg(*[F.percentile_approx(F.when(sentences, F.col(c)), 0.5, 1000).alias(f"own_{c}") for c in USUAL], F.count_if(sentences).alias("n"))
    anywhere = prose.where(sentences).groupBy("size").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"any_{c}") for c in USUAL], F.count(F.lit(1)).alias("any_n"))

    def blend(median: Column, n: Column, rest: Column) -> Column:
        return (F.coalesce(median * n, F.lit(0.0)) + USUAL_BLOCKS * rest) / (F.coalesce(n, F.lit(0)) + USUAL_BLOCKS)

    both = own.join(F.broadcast(anywhere), "size", "left")
    for c, usual in USUAL.items():
        fixed = F.element_at(F.array(*map(F.lit, usual)), F.col("size") + 1)
        norm = blend(F.col(f"own_{c}"), F.col("n"), blend(F.col(f"any_{c}"), F.col("any_n"), fixed))
        both = both.withColumn(f"norm_{c}", F.greatest(norm, LEAST_SHARE * fixed))
    return both.select("lang", "size", "norm_raw", "norm_shape")


def spam_share(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, chars, spam_share, redundant_blocks, blocks, least_raw, least_shape of each text.

    ``doc_id`` must be a unique whole number. NULL and blank texts give no row; a text shorter than
    a third of a block is one block; long texts are measured whole, block by block; equal texts get
    equal shares; extra columns are ignored.
    """
    measured = cut(spread(df.select(F.col(doc_id).cast("long").alias("doc_id"), language(F.col(lang)).alias("lang"), F.col(text).alias("text"))).mapInPandas(_measure, BLOCK_SCHEMA))
    norms = _norms(measured)
    b = measured.join(F.broadcast(norms), ["lang", "size"]).withColumns({f"rel_{c}": F.col(c) / F.col(f"norm_{c}") for c in USUAL})
    redundant = (F.col("rel_raw") < REDUNDANT_BELOW) | (F.col("rel_shape") < REDUNDANT_BELOW)
    return b.groupBy("doc_id").agg(
        F.sum("chars").alias("chars"),
        (F.sum(F.when(redundant, F.col("loose")).otherwise(0)) / F.sum("chars")).alias("spam_share"),
        (F.sum("loose") / F.sum("chars")).alias("loose_share"),
        F.count_if(redundant).alias("redundant_blocks"),
        F.count(F.lit(1)).alias("blocks"),
        F.min("rel_raw").alias("least_raw"),
        F.min("rel_shape").alias("least_shape"),
    )


def spam_documents(df: DataFrame, above: float = 0.5, **columns: str) -> DataFrame:
    """Texts of which more than ``above`` is spam."""
    return spam_share(df, **columns).where(F.col("spam_share") > above)
