"""Quality rules: repetition and signs of a text, and how well public vocabularies fit it.

A vocabulary that was learned from ordinary text splits ordinary text into few, varied tokens.  Characters per token,
the share of byte-fallback tokens and the entropy of the tokens are measured for every whole text, under a vocabulary of
pieces and one of many languages, and must lie in the bands of the text's main script under both.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dielens.llm.text import WordStore, batch, map_arrow, slices, sums, texts_of, vocabulary
from dielens.llm.token_counts import marked, piece_bpe
from dielens.llm.words import Texts, byte_class, covered, mixed, window_names, window_starts

INSIDE = byte_class(r"[^\x20\x09-\x0D]")
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Scripts, and where the letters of one begin: from a code point on, up to the next one of the table.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "other")
RANGES = (
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00C0, "latin"),
    (0x00D7, "none"), (0x00D8, "latin"), (0x00F7, "none"), (0x00F8, "latin"), (0x0300, "none"), (0x0370, "greek"),
    (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "semitic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "other"),
    (0x1100, "east_asian"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"),
    (0x2E00, "none"), (0x2E80, "east_asian"), (0x3000, "none"), (0x3041, "east_asian"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xA960, "east_asian"), (0xA980, "other"),
    (0xAC00, "east_asian"), (0xD800, "none"), (0xF900, "east_asian"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFB1D, "semitic"), (0xFE00, "none"), (0xFE70, "semitic"), (0xFEFF, "none"), (0xFF21, "latin"), (0xFF3B, "none"),
    (0xFF41, "latin"), (0xFF5B, "none"), (0xFF66, "east_asian"), (0xFFE0, "none"), (0x10000, "other"), (0x1F000, "none"),
    (0x20000, "east_asian"), (0x40000, "none"),
)
RANGE_AT = np.array([at for at, _ in RANGES])
RANGE_SCRIPT = np.array([SCRIPTS.index(script) for _, script in RANGES])
#: Rejection bands by vocabulary and script for texts of at least ``min_tokens`` tokens: least and most characters per
#: token, largest share of tokens that are bytes and no characters, least token entropy as a share of that of all tokens
#: different (13 bits at most).  The least characters per token lie between ordinary text and letters drawn at random.
BANDS = {
    "piece": {
        "latin": (1.25, 8.0, 0.30, 0.25),
        "greek": (0.70, 8.0, 0.60, 0.25),
        "cyrillic": (1.40, 8.0, 0.40, 0.25),
        "semitic": (0.70, 8.0, 0.70, 0.25),
        "indic": (0.40, 8.0, 0.90, 0.20),
        "east_asian": (0.45, 8.0, 0.85, 0.20),
        "other": (0.20, 8.0, 1.00, 0.15),
        "none": (1.05, 8.0, 0.50, 0.10),
    },
    "multi": {
        "latin": (1.50, 16.0, 0.30, 0.20),
        "greek": (1.30, 16.0, 0.30, 0.20),
        "cyrillic": (1.40, 16.0, 0.30, 0.20),
        "semitic": (1.20, 16.0, 0.50, 0.20),
        "indic": (0.50, 16.0, 0.90, 0.15),
        "east_asian": (0.55, 16.0, 0.90, 0.15),
        "other": (0.20, 16.0, 1.00, 0.10),
        "none": (0.30, 16.0, 0.80, 0.10),
    },
}
#: A word is measured by the second vocabulary in stretches of so many characters.
STRETCH = 64

FIELDS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_tokens", "n_byte_tokens",
    "n_multi_tokens", "n_multi_byte_tokens",
)


def _script_of(point: np.ndarray) -> np.ndarray:
    return RANGE_SCRIPT[np.searchsorted(RANGE_AT, point, side="right") - 1]


def scripts(texts: Texts) -> np.ndarray:
    """The script that most letters of each text have, as a place in ``SCRIPTS``; the first of several."""
    raw = np.concatenate([texts.bytes, np.zeros(3, np.uint8)])
    at = np.flatnonzero((texts.bytes & 0xC0) != 0x80)
    at = at[raw[at] >= 0x41]
    found = _script_of(np.arange(128))[np.minimum(raw[at], 127)]
    for size, least, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        own = np.flatnonzero((raw[at] >= least) & (raw[at] < 256 - mask - 1))
        point = raw[at[own]].astype(np.int64) & mask
        for k in range(1, size):
            point = point << 6 | raw[at[own] + k] & 0x3F
        found[own] = _script_of(point)
    counts = [np.searchsorted(x, texts.end) - np.searchsorted(x, texts.start) for x in (at[found == k] for k in range(1, len(SCRIPTS)))]
    counts = np.stack(counts)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0) + 1, 0)


@lru_cache(2)
def multi_bpe(path: str) -> tuple[WordStore, np.ndarray]:
    """A byte-level vocabulary of ranks, asked once for each different word, and which of its tokens are no whole characters."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary(path), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    partial = np.zeros(max(ranks.values()) + 1, bool)
    for token, rank in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            partial[rank] = True

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, count = [], np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            ids = bpe.encode_ordinary(" " + word[:STRETCH])
            for at in range(STRETCH, len(word), STRETCH):
                ids += bpe.encode_ordinary(word[at : at + STRETCH])
            flat += ids
            count[k] = len(ids)
        return np.array(flat, np.int32), count

    def cut(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end = texts.runs(INSIDE)
        return start, end, texts.per_text(start)

    return WordStore(cut, encode, np.int32), partial


def repeats(owner: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each named thing of an owner: whether its owner has it again, and whether the owner had it before."""
    key = mixed(names ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[by[1:][same]] = again[by[:-1][same]] = True
    before[by[1:][same]] = True
    return again, before


def base_counts(texts: Texts, window: int = 8) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    start, end = texts.runs(INSIDE)
    n_words = texts.per_text(start)
    rising = np.zeros(len(texts.bytes) + 1, np.int64)
    chars = (texts.bytes & 0xC0) != 0x80
    np.cumsum(chars & INSIDE[texts.bytes], out=rising[1:])
    word_chars = rising[texts.end] - rising[texts.start]
    np.cumsum(SYMBOL[texts.bytes], out=rising[1:])
    n_symbols = rising[texts.end] - rising[texts.start]
    names = texts.names(start, end)
    # lines: between line ends; the one behind each text ends its last line
    stops = np.flatnonzero(texts.bytes == 10)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    worded = np.searchsorted(start, stops) > np.searchsorted(start, begins)
    begins, stops = begins[worded], stops[worded]
    owner = np.searchsorted(texts.end, begins)
    _, before = repeats(owner, texts.names(begins, stops) ^ mixed((stops - begins).astype(np.uint64)))
    n_dup_lines = np.bincount(owner[before], minlength=len(n_words))
    at = np.flatnonzero(window_starts(n_words, window))
    doc = np.repeat(np.arange(len(n_words)), n_words)
    again, _ = repeats(doc[at], window_names(names, window)[at])
    n_repeat = sums(covered(at[again], window, len(names)).astype(np.int64), n_words)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def _fit(ids: np.ndarray, count: np.ndarray, is_byte: np.ndarray) -> list[np.ndarray]:
    """Tokens of ``is_byte`` and token entropy (bits) of every text."""
    byte = sums(is_byte[ids].astype(np.int64), count)
    owner = np.repeat(np.arange(len(count)), count)
    key = np.sort(owner << 20 | ids)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    often = np.diff(np.append(edge, len(key)))
    doc = key[edge] >> 20
    weight = np.bincount(doc, often * np.log2(np.maximum(often, 1)), len(count))
    n = np.maximum(count, 1)
    return [byte, np.maximum(np.log2(n) - weight / n, 0.0)]


def measure(
    docs: DataFrame,
    vocab: str = "piece_bpe_32k.model",
    multi: str = "byte_bpe_multi_50k.tiktoken",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(``FIELDS``, token_entropy, multi_entropy, script) of every whole text, one row per row of ``docs``.

    The first vocabulary (a sentencepiece model) reads the text, the second (byte-level ranks) its words one by one.
    Null and empty texts have zeros and the script ``none``; a null id stays null.
    """
    reals = [("token_entropy", pa.float64()), ("multi_entropy", pa.float64())]
    schema = pa.schema([(c, pa.int64()) for c in FIELDS] + reals + [("script", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, (store, partial) = piece_bpe(vocab), multi_bpe(multi)
        piece_byte = np.zeros(1 << 20, bool)
        piece_byte[bpe.first_byte : bpe.first_byte + bpe.n_bytes] = True
        for part in (part for b in batches for part in slices(b)):
            texts = Texts(part.column("text"))
            counts = base_counts(texts)
            chars = np.concatenate([[0], np.cumsum((texts.bytes & 0xC0) != 0x80)])
            n_chars = chars[texts.end] - chars[texts.start]
            names = np.array(SCRIPTS, object)[scripts(texts)].tolist()
            ids, count = store.texts(texts)
            multi_byte, multi_entropy = _fit(ids.astype(np.int64), count, partial)
            del texts, chars
            ids, n_tokens = bpe.store.texts(marked(part.column("text")))
            byte, entropy = _fit(ids.astype(np.int64), n_tokens, piece_byte)
            own = [n_chars, n_tokens, byte, count, multi_byte, entropy, multi_entropy, names]
            yield batch(schema, part.column("doc_id"), *counts, *own)

    ddl = ", ".join(f"{c} long" for c in FIELDS) + ", token_entropy double, multi_entropy double, script string"
    return map_arrow(texts_of(docs, id_col, text_col), run, ddl)


def judge(measured: DataFrame, bands: dict = BANDS, min_tokens: int = 50) -> DataFrame:
    """Adds chars_per_token, byte_share, entropy_share (and the same as multi_...), base_failed and kept.

    A kept text lies in the bands of its script in both vocabularies.  A text of fewer than ``min_tokens`` tokens is too
    short to measure and passes the bands; a script without a band has that of ``other``.
    """

    def band(vocab: str, k: int) -> Column:
        table = F.create_map(*[F.lit(x) for name, b in bands[vocab].items() for x in (name, float(b[k]))])
        return F.coalesce(F.try_element_at(table, F.col("script")), F.lit(float(bands[vocab]["other"][k])))

    def shares(df: DataFrame, chars: str, tokens: str, byte: str, entropy: str, prefix: str) -> DataFrame:
        n = F.col(tokens)
        some = F.greatest(n, F.lit(1))
        even = F.when(n > 1, F.col(entropy) / F.least(F.log2(n), F.lit(13.0))).otherwise(1.0)
        return df.withColumns(
            {f"{prefix}chars_per_token": F.col(chars) / some, f"{prefix}byte_share": F.col(byte) / some, f"{prefix}entropy_share": even}
        )

    def fits(vocab: str, prefix: str) -> Column:
        return (
            F.col(f"{prefix}chars_per_token").between(band(vocab, 0), band(vocab, 1))
            & (F.col(f"{prefix}byte_share") <= band(vocab, 2))
            & (F.col(f"{prefix}entropy_share") >= band(vocab, 3))
        )

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    shown = shares(measured, "n_chars", "n_tokens", "n_byte_tokens", "token_entropy", "")
    shown = shares(shown, "word_chars", "n_multi_tokens", "n_multi_byte_tokens", "multi_entropy", "multi_")
    return shown.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & ((F.col("n_tokens") < min_tokens) | (fits("piece", "") & fits("multi", "multi_")))
    )
