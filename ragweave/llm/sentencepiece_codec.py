"""SentencePiece BPE encoding and decoding through a prefix table.

For every prefix of a text the merge procedure has exactly one last token. The table stores that token: an
Aho-Corasick automaton lists the vocabulary pieces that end at a position, and the one whose pair with the last
token of the remaining prefix is compatible (the two concatenated merge back to just these two) is the entry. Ids
are then read off backwards. Pieces never hold a word mark after another character, so words are independent and
their ids are kept in a bounded per-worker cache.
"""

from __future__ import annotations

import re
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import map_slices, texts_of

MARK = "▁"
#: Words whose ids a worker keeps in each of two generations; the older one goes when the younger is full. This changes speed only.
CACHE_WORDS = 250_000
#: Longer words are encoded anew each time, so that the bytes kept are bounded too.
CACHE_LETTERS = 64
#: Text bytes worked on at once.
_SLICE = 1 << 20
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTableCodec:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.end_id = model.eos_id()
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.surface: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i) and not model.is_unused(i):
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.surface[i] = piece.replace(MARK, " ").encode()
        self.alphabet = frozenset(c for p in self.ids for c in p)
        self.tokens: list[str] = []
        self.automaton = ahocorasick.Automaton()
        for p in [*self.ids, *(c for c in sorted(self.alphabet) if c not in self.ids)]:
            if self._merge(p) == [p]:  # a piece the merges never build is no table entry
                self.automaton.add_word(p, (len(self.tokens), len(p)))
                self.tokens.append(p)
        self.automaton.make_automaton()
        self.token_ids = [self._fallback(p) if p not in self.ids else (self.ids[p],) for p in self.tokens]
        self._pairs: dict[int, bool] = {}
        self.unknown = re.compile(f"[^{re.escape(''.join(sorted(self.alphabet)))}]")
        self.inside = frozenset(p[i : i + 2] for p in self.tokens for i in range(len(p) - 1))
        codec = weakref.proxy(self)  # no cycle, so that words go with their codec at once

        class Words(dict):
            older: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                if len(word) > CACHE_LETTERS:
                    return codec.encode_word(word)
                out = self.older.get(word)
                if out is None:
                    out = codec.encode_word(word)
                if len(self) >= CACHE_WORDS:
                    self.older = dict(self)
                    self.clear()
                self[word] = out
                return out

        self.words = Words()

    def _fallback(self, chars: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in chars.encode())

    def _merge(self, text: str) -> list[str]:
        """The defining procedure, for short strings: merge the best-scored adjacent pair, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                if (s := score.get(parts[i] + parts[i + 1])) is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            if len(self._pairs) >= 2_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self._merge(a + b) == [a, b]
        return known

    def _known(self, text: str) -> list[int]:
        """Ids of a string of known characters: fill the prefix table, then walk it backwards."""
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible = self._pairs, self._compatible
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if start := end - length:
                left = last[start]
                if left < 0:
                    continue
                ok = pairs.get(left << 20 | token)
                if not (compatible(left, token) if ok is None else ok):
                    continue
            last[end], size[end] = token, length
        out: list[tuple[int, ...]] = []
        while n:
            out.append(self.token_ids[last[n]])
            n -= size[n]
        return [i for ids in reversed(out) for i in ids]

    def encode_word(self, word: str) -> bytes:
        """Ids as int32 bytes. Between two characters that no piece holds side by side, a token always ends."""
        inside, n = self.inside, len(word)
        cuts = [i for i in range(1, n) if word[i - 1 : i + 1] not in inside]
        if not cuts or n - len(cuts) < 2:
            return np.asarray(self.encode_chunk(word), dtype=np.int32).tobytes()
        return b"".join(self.words[word[a:b]] for a, b in zip([0, *cuts], [*cuts, n]))

    def encode_chunk(self, chunk: str) -> list[int]:
        if not self.unknown.search(chunk):
            return self._known(chunk)
        out, at = [], 0
        for m in self.unknown.finditer(chunk):
            if m.start() > at:
                out += self._known(chunk[at : m.start()])
            out += self._fallback(m[0])
            at = m.end()
        return out + (self._known(chunk[at:]) if at < len(chunk) else [])

    def encode(self, text: str) -> bytes:
        """Ids as int32 bytes, with the end id."""
        end = np.int32(self.end_id).tobytes()
        if not text:
            return end
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            chunks = _CHUNK.findall(MARK + text.replace(" ", MARK))
        else:
            chunks = (MARK + text.replace(" ", f" {MARK}")).split(" ")
        return b"".join(map(self.words.__getitem__, chunks)) + end

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


class Shared:
    """The codec of a broadcast, built once in each worker process. Spark takes broadcasts from a reused worker before a
    task that does not name them, so a codec and its words are not held beside the tables of a later stage."""

    def __init__(self, model_path: str):
        self.model_path = model_path

    def __getstate__(self):
        return {"model_path": self.model_path}

    def ready(self) -> PrefixTableCodec:
        if not hasattr(self, "codec"):
            self.codec = PrefixTableCodec(self.model_path)
        return self.codec


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """(key, ids array<int>, decoded string) of every row.

    Null and empty texts have the end id alone and decode to the empty text. Rows are independent: repeated rows
    and ids stay, extra columns are ignored, an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Shared(model_path or default_model()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = sent.value.ready()
        encoded = [c.encode(x) for x in texts_of(batch, "_text")]
        offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
        np.cumsum([len(x) >> 2 for x in encoded], out=offsets[1:])
        flat = np.frombuffer(b"".join(encoded), dtype=np.int32)
        ids = flat.tolist()
        decoded = [c.decode(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], ["_key", "ids", "decoded"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    return map_slices(rows, run, f"_key {kind}, ids array<int>, decoded string", "_text", _SLICE).withColumnRenamed("_key", key)
