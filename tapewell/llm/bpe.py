"""Byte-pair encoding as a tokenization automaton, and decoding by its arc labels.

The automaton has one state per token: the last token read.  It accepts exactly the token sequences that merging
would give.  It starts with one state per byte and every arc; each merge ``u v -> w``, taken in rank order, applies
one gadget: ``w`` becomes a state with the arcs that leave ``v`` at that moment, every state with an arc to ``u``
gets the same arc to ``w``, and the arc from ``u`` to ``v`` goes (from ``u`` to ``w`` too if ``u = v``, as runs
merge from the left).  The 2.5 billion arcs of a 50,000 token vocabulary would not fit a worker, so the construction
is kept as its gadgets and an arc is worked out on first use and then kept in a table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tapewell.llm.words import slices

# The white space of the vocabulary's splitting rule, and that rule.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORDS_KEPT = 200_000
ARCS_KEPT = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, description: bytes) -> None:
        model = json.loads(description)
        letters = _byte_letters()
        ids = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.labels = [b""] * size
        for text, i in ids.items():
            self.labels[i] = text.encode() if text in self.special else bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.gadget: dict[int, int] = {}  # the arc u -> v a gadget takes away, with the gadget's rank
        self.size = size
        for rank, pair in enumerate(model["model"]["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            w = ids[u + v]
            self.left[w], self.right[w], self.rank[w] = ids[u], ids[v], rank
            self.gadget[ids[u] * size + ids[v]] = rank
        # Spelling table: (node, byte) -> node, and the token spelt at a node.
        self.step: dict[int, int] = {}
        self.spelt = [-1]
        specials = set(self.special.values())
        for i in ids.values():
            if i in specials:
                continue
            node = 0
            for b in self.labels[i]:
                node = self.step.setdefault(node << 8 | b, len(self.spelt))
                if node == len(self.spelt):
                    self.spelt.append(-1)
            self.spelt[node] = i
        # The same tables as arrays: nodes that lead on come first and have a row each; 0 stands for "no such node".
        inner = sorted({k >> 8 for k in self.step})
        number = np.zeros(len(self.spelt), np.int32)
        number[inner] = np.arange(len(inner))
        outer = np.setdiff1d(np.arange(len(self.spelt)), inner)
        number[outer] = np.arange(len(inner), len(self.spelt))
        self.inner = len(inner)
        self.table = np.zeros((len(inner), 256), np.int32)
        keys = np.fromiter(self.step.keys(), np.int64, len(self.step))
        self.table[number[keys >> 8], keys & 255] = number[np.fromiter(self.step.values(), np.int64, len(self.step))]
        self.token = np.empty(len(self.spelt), np.int64)
        self.token[number] = self.spelt
        self.length = np.array([len(x) for x in self.labels], np.int64)
        self.parts = np.array([self.left, self.right, self.rank], np.int64)
        order = sorted(self.gadget)
        self.gadgets = np.array(order, np.int64), np.array([self.gadget[k] for k in order], np.int64)
        self.arc_key, self.arc_ok = np.full(ARCS_KEPT, -1, np.int64), np.zeros(ARCS_KEPT, bool)
        self.known: dict[str, bytes] = {}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split = regex.compile(SPLIT)

    def _arcs(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether token ``t`` may follow token ``p``, by undoing gadgets from the newest back to the bytes."""
        left, right, rank = self.parts
        keys, ranks = self.gadgets
        ok = np.ones(len(p), bool)
        live, before = np.arange(len(p)), np.full(len(p), 1 << 60)
        while len(live):
            arc = p * self.size + t
            at = np.minimum(np.searchsorted(keys, arc), len(keys) - 1)
            twin, newer, older = (p == t) & (rank[p] >= 0), rank[p] > rank[t], rank[t] >= 0
            gone = (keys[at] == arc) & (ranks[at] < before) if len(keys) else np.zeros(len(p), bool)
            gone |= ~twin & ~newer & older & (left[t] == p) & (right[t] == p)
            ok[live[gone]] = False
            on = ~gone & (twin | newer | older)
            p, t, twin, newer, live = p[on], t[on], twin[on], newer[on], live[on]
            before = np.where(twin | newer, rank[p], rank[t])
            p, t = np.where(twin | newer, right[p], p), np.where(twin | ~newer, left[t], t)
        return ok

    def _allowed(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """``_arcs`` through a table of the arcs met before, one place for each hash."""
        arc = p * self.size + t
        place = (arc * 0x9E3779B1 >> 12) & (ARCS_KEPT - 1)
        new = np.flatnonzero(self.arc_key[place] != arc)
        if len(new):
            fresh, back = np.unique(arc[new], return_inverse=True)
            ok = self._arcs(fresh // self.size, fresh % self.size)
            out = self.arc_ok[place]
            out[new] = ok[back]
            self.arc_key[place[new]], self.arc_ok[place[new]] = arc[new], ok[back]
            # Two new arcs may share a place: the one whose key stayed has its own answer there.
            self.arc_ok[place[new]] = ok[np.searchsorted(fresh, self.arc_key[place[new]])]
            return out
        return self.arc_ok[place]

    def words(self, words: list[bytes]) -> list[bytes]:
        """The accepted path of each word, words of like length together.

        Each prefix of a word has one path and so one last token; it is found from those of shorter prefixes: from
        every place, the spelling table is followed byte by byte, and a token it spells is taken if the automaton
        has the arc from the last token before it.
        """
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            limit = max(8, int(size[order[i]]) * 5 // 4)
            j = int(np.searchsorted(size[order], limit, "right"))
            j = min(j, i + max(1, 4_000_000 // limit))
            own = order[i:j]
            self._paths([words[k] for k in own], size[own], own, out)
            i = j
        return out

    def _paths(self, words: list[bytes], size: np.ndarray, own: np.ndarray, out: list[bytes]) -> None:
        m, width = len(words), int(size.max())
        text = np.zeros((m, width + 1), np.uint8)
        text[:, :width] = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        last = np.full((m, width + 1), -1, np.int64)
        for j in range(width):
            row = np.flatnonzero(size > j)
            p, node, i = last[row, j], np.zeros(len(row), np.int64), j
            while len(row):
                node = self.table[node, text[row, i]]
                on = node > 0
                if not on.all():
                    row, p, node = row[on], p[on], node[on]
                t = self.token[node]
                hit = np.flatnonzero(t >= 0)
                if j and len(hit):
                    hit = hit[self._allowed(p[hit], t[hit])]
                last[row[hit], i + 1] = t[hit]
                i += 1
                on = (node < self.inner) & (size[row] > i)
                row, p, node = row[on], p[on], node[on]
        ids, at, step = np.zeros((m, width), np.uint32), size.copy(), 0
        row = np.arange(m)
        count = np.zeros(m, np.int64)
        while len(row):
            t = last[row, at[row]]
            step += 1
            ids[row, width - step] = t
            count[row] = step
            at[row] -= self.length[t]
            row = row[at[row] > 0]
        for k, line, n in zip(own.tolist(), ids, count.tolist(), strict=True):
            out[k] = line[width - n :].tobytes()

    def _learn(self, pieces: list[list[str]]) -> dict[str, bytes]:
        """Paths of all words of ``pieces``: from the table of words met before, or worked out now."""
        known = self.known
        fresh = {w for words in pieces for w in words if w not in known}
        if not fresh:
            return known
        fresh_list = list(fresh)
        if len(known) + len(fresh_list) > WORDS_KEPT:
            keep = {w: known[w] for words in pieces for w in words if w in known}
            known.clear()
            known.update(keep)
        known.update(zip(fresh_list, self.words([w.encode() for w in fresh_list]), strict=True))
        return known

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[list[str]] = []
        plan: list[list[int | bytes]] = []
        for text in texts:
            if self.cut is None or not self.cut.search(text):
                plan.append([len(pieces)])
                pieces.append(self.split.findall(text))
                continue
            steps, at = [], 0
            for m in self.cut.finditer(text):
                steps += [len(pieces), self.special[m[0]].to_bytes(4, "little")]
                pieces.append(self.split.findall(text[at : m.start()]))
                at = m.end()
            plan.append([*steps, len(pieces)])
            pieces.append(self.split.findall(text[at:]))
        known = self._learn(pieces)
        return [b"".join([s if isinstance(s, bytes) else b"".join([known[w] for w in pieces[s]]) for s in steps]) for steps in plan]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the joined arc labels; broken sequences become U+FFFD."""
        raw = b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


_COMPILED: dict[str, Automaton] = {}


def _compiled(description: bytes) -> Automaton:
    key = hashlib.sha256(description).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Automaton(description)
    return _COMPILED[key]


def load(spark: SparkSession, path: str):
    """The tokenizer file (a fixed 2 MB) read on the driver, for the workers to compile."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``documents`` with ``ids`` (binary, little-endian unsigned 32-bit).  Null and empty texts have no ids; rows and
    other columns stay, except that a column named ``ids`` is replaced."""
    documents = documents.drop("ids")
    model = load(documents.sparkSession, path)
    schema = documents.selectExpr("*", "cast(null as binary) as ids").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _compiled(model.value)
        for batch in batches:
            for part in slices(batch, text):
                ids = auto.encode_batch([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [f.name for f in schema])

    return documents.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (string): the arc labels of ``ids``; null ids decode to the empty text."""
    encoded = encoded.drop("decoded")
    model = load(encoded.sparkSession, path)
    schema = encoded.selectExpr("*", "cast(null as string) as decoded").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _compiled(model.value)
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [auto.decode(x or b"").decode() for x in part.column(part.schema.get_field_index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [f.name for f in schema])

    return encoded.mapInArrow(run, schema)
