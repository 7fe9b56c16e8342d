"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE can produce, so each string has one
accepted path.  It starts with one state that has an arc for every base symbol.  Each merge (u, v) -> w adds one
gadget: u now leads to a copy of its former state that lacks the arc v, and every state with an arc u gets an arc w
that leads where v led.  The state that a token leads to is thus a chain of gadgets: its own, then those that its
right part had when the token was made, and so on; and a state has an arc with a label as it had one with the label's
left part when the label was made.  Gadgets are kept as rows (token, removed label, rank), from which every arc is
read, so the automaton of 49 thousand merges stays a few arrays.

Words are encoded by table-driven transitions over all different words of a batch at once: for every prefix exactly
one token ends the accepted path, so a prefix keeps that token, and the next one follows from the arcs.  Decoding
emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from dielens.llm.text import Ragged, WordStore, batch, map_arrow, slices, spread, sums, texts_of, vocabulary
from dielens.llm.words import Texts, byte_class

#: Fixed value: words longer than this are encoded one by one instead of in arrays of equal length.
LONG = 48
#: Bounds memory only: the pieces and the words a worker keeps.
KEPT = 100_000
NEVER = np.iinfo(np.int32).max
#: Stands in no label of a byte-level vocabulary.
SEPARATOR = "\x01"
PART = byte_class(r"[^\x20\n]")
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
#: Fixed value: signs that are in no contraction and in no special string.
APART = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;=?@[]^_{}~", np.uint8))


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    """``merges`` are pairs of labels in rank order; ``vocab`` gives the id of each label."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], base: list[str]):
        size = max(vocab.values()) + 1
        self.gadgets: dict[int, int] = {}
        self.parts = [NEVER] * size, [-1] * size, [-1] * size  # rank, left and right part of each label
        made, left, right = self.parts
        spelled = {}
        for label in base:
            made[vocab[label]] = -1
            spelled[vocab[label]] = label
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if NEVER in (made[u], made[v]) or made[w] != NEVER or not self._has_arc(u, v):
                continue
            self.gadgets[u << 20 | v] = rank
            made[w], left[w], right[w] = rank, u, v
            spelled[w] = a + b
        self.made, self.left, self.right = (np.array(x, np.int32) for x in self.parts)
        keys = sorted(self.gadgets)
        self.gadget_keys = np.array(keys, np.int64)
        self.gadget_ranks = np.array([self.gadgets[k] for k in keys], np.int32)
        self.memo_key = np.full(1 << 20, -1, np.int64)
        self.memo_arc = np.zeros(1 << 20, bool)
        self.known: dict[int, bool] = {}
        self._trie(spelled, vocab, base)

    def _has_arc(self, token: int, label: int) -> bool:
        """Whether the state after ``token`` has an arc with ``label``: no gadget of the chain has removed it."""
        made, left, right = self.parts
        u, before = token, NEVER
        while u >= 0:
            y, until = label, NEVER
            while y >= 0:
                rank = self.gadgets.get(u << 20 | y)
                if rank is not None and rank < before and rank <= until:
                    return False
                until, y = made[y], left[y]
            before, u = made[u], right[u]
        return True

    def has_arcs(self, token: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The same for arrays; token -1 stands for the first state."""
        key = (token.astype(np.int64) + 1) << 20 | label
        slot = (key * 0x2545F4914F6CDD1D >> 40) & 0xFFFFF
        out = self.memo_arc[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            out[miss] = self._arcs(token[miss], label[miss])
            self.memo_key[slot[miss]], self.memo_arc[slot[miss]] = key[miss], out[miss]
        return out

    def _arcs(self, token: np.ndarray, label: np.ndarray) -> np.ndarray:
        out = np.ones(len(token), bool)
        rows = np.flatnonzero(token >= 0)
        u, before = token[rows], np.full(len(rows), NEVER)
        while len(rows):
            own, y, until = np.arange(len(rows)), label[rows], np.full(len(rows), NEVER)
            while len(own):
                key = u[own].astype(np.int64) << 20 | y
                at = np.searchsorted(self.gadget_keys, key)
                at[at == len(self.gadget_keys)] = 0
                rank = self.gadget_ranks[at]
                gone = (self.gadget_keys[at] == key) & (rank < before[own]) & (rank <= until)
                out[rows[own[gone]]] = False
                until, y = self.made[y], self.left[y]
                stay = (y >= 0) & ~gone
                own, y, until = own[stay], y[stay], until[stay]
            before, u = self.made[u], self.right[u]
            stay = (u >= 0) & out[rows]
            rows, u, before = rows[stay], u[stay], before[stay]
        return out

    def _trie(self, parts: dict[int, str], vocab: dict[str, int], base: list[str]) -> None:
        """Labels as words over base symbols, read from their ends: key = node * 512 + symbol."""
        number = {label: k for k, label in enumerate(base)}
        self.symbol_id = np.array([vocab[label] for label in base], np.int32)
        child: dict[int, int] = {}
        token = [-1]
        for k, label in parts.items():
            word = [number[label]] if label in number else self._spelled(label, number)
            node = 0
            for x in reversed(word):
                key = node * 512 + x
                if key not in child:
                    child[key] = len(token)
                    token.append(-1)
                node = child[key]
            token[node] = k
        self.child, self.token = child, token
        keys = np.array(sorted(child), np.int64)
        self.keys, self.nodes = keys, np.array([child[k] for k in keys.tolist()], np.int32)
        self.tokens = np.array(token, np.int32)

    @staticmethod
    def _spelled(label: str, number: dict[str, int]) -> list[int]:
        end = label.endswith("</w>")
        chars = label[:-4] if end else label
        out = [number[c] for c in chars[: -1 if end else None]]
        return [*out, number[chars[-1] + "</w>"]] if end else out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each; the last byte takes a word end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray | None] = [None] * len(words)
        count = np.zeros(len(words), np.int64)
        pieces, places = [], []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n == 0:
                continue
            if n > LONG:
                for r in rows.tolist():
                    out[r] = np.array(self._long(words[r]), np.int32)
                    count[r] = len(out[r])
                continue
            symbols = np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8)
            symbols = symbols.reshape(len(rows), n).astype(np.int32)
            symbols[:, -1] += 256
            flat, lens = self._equal(symbols)
            count[rows] = lens
            pieces.append(flat)
            places.append(rows)
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for ids, rows in zip(pieces, places, strict=True):
            flat[spread(ends[rows] - count[rows], count[rows])] = ids
        for r in np.flatnonzero(size > LONG).tolist():
            flat[ends[r] - count[r] : ends[r]] = out[r]
        return flat, count

    def _equal(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length: the token that ends the path of every prefix, then the paths from their ends."""
        rows, n = symbols.shape
        last = np.full((rows, n + 1), -1, np.int32)
        size = np.zeros((rows, n + 1), np.int32)
        for i in range(1, n + 1):
            own, node = np.arange(rows), np.zeros(rows, np.int64)
            for back in range(1, i + 1):
                key = node * 512 + symbols[own, i - back]
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                found = self.keys[at] == key
                own, node = own[found], self.nodes[at[found]].astype(np.int64)
                if not len(own):
                    break
                token = self.tokens[node]
                ends = np.flatnonzero(token >= 0)
                if len(ends):
                    ends = ends[self.has_arcs(last[own[ends], i - back], token[ends])]
                    done = own[ends]
                    last[done, i], size[done, i] = token[ends], back
                    open_ = np.ones(len(own), bool)
                    open_[ends] = False  # one token only ends the path
                    own, node = own[open_], node[open_]
        out = np.zeros((rows, n), np.int32)
        lens = np.zeros(rows, np.int64)
        at, own = np.full(rows, n), np.arange(rows)
        while len(own):
            lens[own] += 1
            out[own, n - lens[own]] = last[own, at[own]]
            at[own] -= size[own, at[own]]
            own = own[at[own] > 0]
        return out[np.arange(n) >= (n - lens)[:, None]], lens

    def _long(self, word: bytes) -> list[int]:
        symbols = list(word)
        symbols[-1] += 256
        last, size, child, token = [-1], [0], self.child, self.token
        for i in range(1, len(symbols) + 1):
            node = 0
            for back in range(1, i + 1):
                node = child.get(node * 512 + symbols[i - back], -1)
                if node < 0:
                    raise ValueError("a prefix has no path")
                t = token[node]
                if t < 0:
                    continue
                before = last[i - back]
                key = before << 20 | t
                if key not in self.known:
                    if len(self.known) > 200_000:
                        self.known.clear()
                    self.known[key] = self._has_arc(before, t)
                if self.known[key]:
                    last.append(t)
                    size.append(back)
                    break
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


def folded(texts: pa.Array) -> Texts:
    """The texts with A-Z as a-z, which changes no token, unless a special string (its case counts) may be among them."""
    own = Texts(texts)
    return own if b"<|" in own.raw else Texts(texts, lower=True)


def spaced_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts between spaces, line ends, and where a sign of ``APART`` meets a letter a-z.

    The pattern of the file splits at these places too.  Other white space stays inside and is dropped with its part.
    """
    b = texts.bytes
    inside, letter, sign = PART[b], LETTER[b], APART[b]
    cut = np.zeros(len(b), bool)
    cut[1:] = (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:]
    ends[:-1] &= ~inside[1:] | cut[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, texts.per_text(start)


class WordBpe:
    """The tokenizer of a JSON file whose model is BPE with word ends over byte symbols.

    White space is dropped; special strings are found in the raw text; the rest is composed (NFC), put in lower
    case character by character, and split by the file's own pattern.
    """

    def __init__(self, path: str):
        with open(vocabulary(path), encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.vocab = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        chars = byte_symbols()
        self.automaton = Automaton(self.vocab, merges, chars + [c + model["end_of_word_suffix"] for c in chars])
        self.special = {a["content"]: a["id"] for a in said["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        splits = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(splits)
        labels = dict(zip(self.vocab.values(), self.vocab, strict=True)) | {i: s for s, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.compose = normalizers.NFC()  # the library's own tables, which are older than Python's
        self.known: dict[str, int] = {}
        self.rows = Ragged(np.int32)
        self.store = WordStore(spaced_words, self.encode, np.int32, KEPT)

    def _pieces(self, part: str) -> list[str]:
        if not part.isascii():
            part = self.compose.normalize_str(part)
        low = part.replace("Σ", "σ").lower()
        return [low] if low.isalpha() else self.pieces.findall(low)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without spaces, and the number of ids of each."""
        pieces: list[str] = []
        n_pieces = np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            if "<|" in word:
                own = []
                for part in self.cut.split(word):
                    own += [part] if part in self.special else self._pieces(part)
            else:
                own = self._pieces(word)
            n_pieces[k] = len(own)
            pieces += own
        if len(self.known) > KEPT:
            self.known.clear()
            self.rows = Ragged(np.int32)
        if new := [p for p in dict.fromkeys(pieces) if p not in self.known]:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self._append(new)
        codes = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        flat, count = self.rows.take(codes)
        return flat, sums(count, n_pieces)

    def _append(self, pieces: list[str]) -> None:
        """A special string is a piece of its own; no other piece can equal it, since pieces hold no letters beside signs."""
        flat, count = self.automaton.encode_words(
            [b"" if p in self.special else p.encode("utf-8", "replace") for p in pieces]
        )
        at = np.cumsum(count) - count
        for k in [k for k, p in enumerate(pieces) if p in self.special][::-1]:
            flat, count[k] = np.insert(flat, at[k], self.special[pieces[k]]), 1
        self.rows.append(flat, count)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, with a space between two (the file names no decoder)."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(
    docs: DataFrame, vocab: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every whole text: (doc_id, ids array<int>), one row per row of ``docs``.

    A null or empty text has an empty array; repeated rows give repeated rows; a null id stays null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocab)
        for part in (part for b in batches for part in slices(b)):
            flat, count = bpe.store.texts(folded(part.column("text")))
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            yield batch(schema, part.column("doc_id"), pa.ListArray.from_arrays(ends, flat))

    return map_arrow(texts_of(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab: str = "word_bpe_49k.json", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the labels of each row's ids with a space between two, special strings included.

    No or null ids give an empty text; an id outside the vocabulary gives no label.
    """
    # one constant array, made from one literal and folded when the query is planned
    labels = F.split(F.lit(SEPARATOR.join(word_bpe(vocab).labels)), SEPARATOR, -1)
    emitted = F.array_join(F.transform(ids_col, lambda i: F.get(labels, i)), " ")
    return encoded.withColumn("decoded", F.coalesce(emitted, F.lit("")))
