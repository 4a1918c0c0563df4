"""SentencePiece BPE by a merge-type prefix table.

Each prefix of a text has one encoding, and so one last token; the table holds just that token for each prefix. The tokens that end at
a place come from an automaton over the vocabulary. One of them, t, is the last token of that prefix if the pair (u, t) is
compatible, u being the last token of the prefix that t leaves: two tokens are compatible if merging the symbols of u + t by
the vocabulary's scores gives u and t again. The ids are recovered backwards from the last prefix.

No token spans two characters that stand next to each other in no vocabulary piece, so texts are cut there first, and the
parts' ids are remembered in a bounded cache in each worker. Characters outside the vocabulary become bytes.

Null text counts as empty: begin and end id only. An empty table gives no rows; repeated rows equal values.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import ids_and_texts, lean, slices

SPACE = "▁"
#: Parts and pairs that a worker remembers.
PARTS_KEPT, PAIRS_KEPT = 600_000, 1_000_000
_LOADED: dict[str, "PieceBpe"] = {}


class PieceBpe:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.rank = {p: (-sp.get_score(i), i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i, p))
        self.automaton.make_automaton()
        #: two characters that stand next to each other in some piece
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.parts: dict[str, bytes] = {}
        letters = sorted({c for p in self.ids for c in p if c.isalpha()})
        # runs of letters with the space mark before them, or anything else between two such runs: a first cut that is
        # only used where each of its borders is one that no piece spans
        self.rough = re.compile(f"{SPACE}*[{re.escape(''.join(letters))}]+|[^{re.escape(''.join(letters))}]+?(?={SPACE}*[{re.escape(''.join(letters))}]|$)", re.S)
        self.borders: dict[str, bool] = {}

    @staticmethod
    def get(path: str) -> "PieceBpe":
        if path not in _LOADED:
            _LOADED[path] = PieceBpe(path)
        return _LOADED[path]

    def merged(self, text: str) -> list[str]:
        """Merges the characters of a short text by score, best first, leftmost among equals."""
        symbols = list(text)
        while True:
            best = None
            for i in range(len(symbols) - 1):
                r = self.rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r[0] < best[0]):
                    best = (r[0], i)
            if best is None:
                return symbols
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def compatible(self, u: str, t: str) -> bool:
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        out = self.pairs[u, t] = self.merged(u + t) == [u, t]
        return out

    def stands(self, t: str) -> bool:
        """Is a piece its own encoding?"""
        out = self.alone[t] = self.merged(t) == [t]
        return out

    def table(self, text: str) -> list[tuple[int, int, str]]:
        """For each prefix its last token as (length, id, token); characters outside the vocabulary have id -1."""
        last: list = [None] * (len(text) + 1)
        alone, pairs = self.alone, self.pairs
        done = 0
        for end, (n, i, t) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # places where no token ends
                done += 1
                if last[done] is None:
                    last[done] = (1, -1, text[done - 1])
            if last[end] is not None:
                continue
            if end == n:
                ok = alone[t] if t in alone else self.stands(t)
            else:
                u = last[end - n]
                if u is None:
                    u = last[end - n] = (1, -1, text[end - n - 1])
                u = u[2]
                ok = pairs[u, t] if (u, t) in pairs else self.compatible(u, t)
            if ok:
                last[end] = (n, i, t)
        for k in range(1, len(text) + 1):
            if last[k] is None:
                last[k] = (1, -1, text[k - 1])
        return last

    def encode_part(self, part: str) -> bytes:
        """Recovers the ids of a part backwards from its table."""
        last, ids, at = self.table(part), [], len(part)
        while at:
            n, i, t = last[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in reversed(t.encode())]
            at -= n
        ids.reverse()
        return array("I", ids).tobytes()

    def cut(self, text: str) -> list[str]:
        """Parts between which no piece reaches."""
        rough = self.rough.findall(text)
        borders = self.borders
        out = []
        for p in rough:
            if out:
                pair = out[-1][-1] + p[0]
                joint = borders.get(pair)
                if joint is None:
                    joint = borders[pair] = pair in self.inner
                if joint:
                    out[-1] += p
                    continue
            out.append(p)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end id, as little-endian unsigned 32-bit integers."""
        begin, end = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        split = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        parts = self.parts
        new: dict[str, bytes] = {}
        out = []
        for ps in split:
            for p in ps:
                if p not in parts and p not in new:
                    new[p] = self.encode_part(p)
            if len(parts) + len(new) <= PARTS_KEPT:
                parts.update(new)
                new = {}
                out.append(begin + b"".join(map(parts.__getitem__, ps)) + end)
            else:
                out.append(begin + b"".join([parts[p] if p in parts else new[p] for p in ps]) + end)
                if len(new) > 200_000:
                    new = {}
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""

    def run(batches):
        bpe = PieceBpe.get(model)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = bpe.encode(texts[a:b])
                text = bpe.decode([array("I", x).tolist() for x in ids])
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[a:b], pa.int64()), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(t.encode()) for t in text]})

    return ids_and_texts(docs).mapInArrow(lean(run), _DIGESTS)


def encode_column(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the ids themselves."""

    def run(batches):
        bpe = PieceBpe.get(model)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[a:b], pa.int64()), "ids": pa.array([array("I", x).tolist() for x in bpe.encode(texts[a:b])], pa.list_(pa.int64()))})

    return ids_and_texts(docs).mapInArrow(lean(run), "doc_id long, ids array<long>")
