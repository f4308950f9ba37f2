"""BPE encoding and decoding by a tokenization automaton.

The automaton's states are tokens (what was emitted last) and its arcs carry
tokens. It starts as one state with a loop for every base symbol; each merge
``(u, v) -> w``, taken in order, is a gadget: wherever ``u`` could be followed
by ``v`` that arc is cut, every state that had an arc ``u`` into the cut state
gains an arc ``w``, and the new state ``w`` inherits the arcs of ``v``. After
all gadgets, a token sequence is a path exactly when BPE itself would produce
it. The transition table is filled on demand: an entry replays only the gadgets
that touch its two tokens, so the table never holds the square of the vocabulary.

A batch's different words are encoded once; what they become is dealt out to their
places as columns. A pre-split word has one path through the automaton. It is walked left to right,
longest arc first; a position that turns out dead is never entered again, so the
walk is linear in the word. Decoding emits the arcs' labels.

Defined cases: a null text is an empty one and has no tokens; added tokens met
in a text are single tokens, as in the tokenizers library; words of any length
are encoded whole; repeated rows are encoded each by itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tracklake.llm.common import map_rows, texts

FOREVER = 1 << 60
END = "</w>"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words remembered by a worker before it starts anew; bounds its memory, not its results.
REMEMBERED = 400_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Automaton:
    """Compiled from the base symbols and the merges, both in order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = END):
        self.end = end
        self.ids = vocab
        self.gadget: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.cut: dict[tuple[str, str], int] = {}
        for i, (u, v) in enumerate(merges):
            self.cut.setdefault((u, v), i)
            self.gadget.setdefault(u + v, i)
            self.halves.setdefault(u + v, (u, v))
        dead: set[str] = set()  # made by a gadget whose arcs had been cut before, so no path has them
        for i, (u, v) in enumerate(merges):
            if self.gadget[u + v] == i and (u in dead or v in dead or not self._replay(u, v, i)):
                dead.add(u + v)
        bare = [(t[: -len(end)], True) if end and t.endswith(end) and t != end else (t, False) for t in vocab if t not in dead]
        self.inner = {t for t, last in bare if not last}
        self.last = {t for t, last in bare if last} if end else self.inner
        self.prefixes = {t[:k] for t, _ in bare for k in range(1, len(t) + 1)}
        self.table: dict[tuple[str, str], bool] = {}

    def arc(self, state: str, token: str) -> bool:
        """Whether ``state`` keeps an arc ``token`` after all gadgets."""
        key = (state, token)
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            known = self.table[key] = self._replay(state, token)
        return known

    def _replay(self, state: str, token: str, until: int = FOREVER) -> bool:
        """Whether the arc is there just before gadget ``until``."""
        gadget = self.gadget
        while True:
            if self.cut.get((state, token), FOREVER) < until:
                return False
            made_token, made_state = gadget.get(token, -1), gadget.get(state, -1)
            if made_token < 0 and made_state < 0:
                return True
            if made_token >= made_state:  # the arc was made beside the arc to the token's left half, and outlived that gadget's cut
                token, until = self.halves[token][0], min(until, made_token + 1)
            else:  # the state's arcs are those its right half had just then
                state, until = self.halves[state][1], min(until, made_state)

    def encode(self, word: str) -> list[str]:
        """The tokens of a pre-split word of base symbols; its last one carries the word's end."""
        n, prefixes, inner, last, end, arc = len(word), self.prefixes, self.inner, self.last, self.end, self.arc
        if not n:
            return []
        path, ends, dead = [], [], set()  # arcs taken and where they end; positions that lead nowhere
        i, most, at = 0, n, ""
        table = self.table
        while i < n:
            j = i + 1
            while j < n and word[i : j + 1] in prefixes:
                j += 1
            j = min(j, most)
            token = None
            while j > i:  # the longest arc first; one path alone spells the word
                x = word[i:j]
                if j == n:
                    token = x + end if x in last else None
                else:
                    token = x if x in inner and j not in dead else None
                if token is not None:
                    if not i:
                        break
                    ok = table.get((at, token))
                    if ok or ok is None and arc(at, token):
                        break
                    token = None
                j -= 1
            if token is not None:
                path.append(token)
                ends.append(j)
                i, most, at = j, n, token
            elif not path:
                raise ValueError(f"{word!r} has a symbol outside the vocabulary")
            else:
                dead.add(i)
                most = ends.pop() - 1
                path.pop()
                i, at = (ends[-1], path[-1]) if path else (0, "")
        return path


class WordCodec:
    """What a tokenizer file says, around the automaton: normalisation, splitting, added tokens."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab = model["vocab"]
        self.machine = Automaton(self.vocab, merges, model.get("end_of_word_suffix") or "")
        splits = [p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(splits[0]).findall
        self.chars = byte_chars()
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        self.labels = {i: t for t, i in (self.vocab | self.added).items()}
        self.known: dict[str, tuple[str, str]] = {}
        self.pieces_known: dict[str, list[str]] = {}

    def tokens(self, text: str) -> list[str]:
        """Tokens of a stretch without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final sigma: each character by itself
        out: list[str] = []
        for p in self.pieces(low):
            got = self.pieces_known.get(p)
            if got is None:
                if len(self.pieces_known) > REMEMBERED:
                    self.pieces_known.clear()
                got = self.machine.encode(p if p.isascii() and p.isprintable() else "".join([self.chars[b] for b in p.encode()]))
                self.pieces_known[p] = got
            out += got
        return out

    def _word(self, w: str) -> tuple[str, str]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        t = self.tokens(w)
        got = self.known[w] = (" ".join([str(self.vocab[x]) for x in t]), " ".join(t))
        return got

    def encode(self, text: str | None) -> tuple[str, str]:
        """Decimal ids and arc labels, both joined by single spaces.

        White space always ends a piece, so each word is encoded once and remembered.
        """
        text = text or ""
        parts = self.cut_added.split(text) if self.cut_added and any(t in text for t in self.added) else [text]
        ids, labels, known = [], [], self.known
        for part in parts:
            if part in self.added:
                ids.append(str(self.added[part]))
                labels.append(part)
            elif any(c in part for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space; the file's patterns don't
                t = self.tokens(part)
                ids += [str(self.vocab[x]) for x in t]
                labels += t
            else:
                got = [known.get(w) or self._word(w) for w in part.split()]
                ids += [x[0] for x in got]
                labels += [x[1] for x in got]
        return " ".join(ids), " ".join(labels)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of every text of a string column the number of tokens, decimal ids and arc labels, as ``encode`` gives them."""
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known, new = self.known, self._word
        got = [known.get(w) or new(w) for w in coded.dictionary.to_pylist()]
        count = np.array([ids.count(" ") + 1 if ids else 0 for ids, _ in got], dtype=np.int64)
        code = coded.indices.to_numpy()
        kept = code[count[code] > 0]  # nothing is left of a word of white space beyond ASCII, nor of what is around the text
        ends = np.concatenate(([0], np.cumsum(count[code] > 0)))[np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy())))]
        total = np.concatenate(([0], np.cumsum(count[kept])))[ends]
        at, offsets = pa.array(kept), pa.array(ends.astype(np.int32))
        ids, labels = (pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(x, pa.string()).take(at)), " ") for x in (zip(*got) if got else ((), ())))
        numbers = np.diff(total)
        odd = np.zeros(len(texts), dtype=bool)
        for t in self.added:
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if odd.any():
            ids, labels = ids.to_pylist(), labels.to_pylist()
            for i in np.flatnonzero(odd).tolist():
                ids[i], labels[i] = self.encode(texts[i].as_py())
                numbers[i] = ids[i].count(" ") + 1 if ids[i] else 0
            ids, labels = pa.array(ids, pa.string()), pa.array(labels, pa.string())
        return numbers, ids, labels

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs; the file has no decoder, so they are joined by spaces."""
        return " ".join([self.labels[i] for i in ids])


@lru_cache(maxsize=4)
def codec(spec: str) -> WordCodec:
    return WordCodec(spec)


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text and return digests of both. A single pass: no shuffle.

    The tokenizer's file (of fixed size) is read by the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        c = codec(spec.value)

        def digests(strings):
            return [hashlib.sha256(x).hexdigest() for x in strings.cast(pa.binary()).to_pylist()]

        def step(batch):
            n, ids, labels = c.encode_column(batch.column("text"))
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": digests(ids), "decoded_sha256": digests(labels)}

        return step

    return map_rows(texts(docs, id_col, text_col), make, SCHEMA)


def encode_column(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        c = codec(spec.value)
        return lambda b: {"doc_id": b.column("doc_id"), "ids": [[int(i) for i in x.split()] for x in c.encode_column(b.column("text"))[1].to_pylist()]}

    return map_rows(texts(docs, id_col, text_col), make, "doc_id long, ids array<int>")
