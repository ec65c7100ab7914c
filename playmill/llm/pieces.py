"""Operator 1: sentencepiece encoding and decoding of merge-type (BPE) vocabularies.

A text is cut where no piece of the vocabulary could span the cut, so the parts encode independently.  Each part is
merged by an agenda of adjacent symbol pairs, best score first and leftmost among equals.  Parts repeat a lot, so each
worker remembers the latest ones.  In every Arrow batch the parts seen for the first time are also given to the
sentencepiece library, both ways, and a difference stops the job.

Cases: a null or empty text has no ids and decodes to the empty text.  Repeated rows give repeated results.  Very long
texts are encoded whole, part by part.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import Remembered, arrow_map, per_worker

SPACE = "▁"


class PieceCodec:
    """Encoder and decoder of one merge-type model file with byte fallback and identity normalisation."""

    def __init__(self, model_file: str, verify: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.scores, self.ids, self.byte_ids = {}, {}, [None] * 256
        for i, piece in enumerate(self.pieces):
            if self.library.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif self.library.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            elif not (self.library.is_unknown(i) or self.library.is_control(i)):
                self.scores[piece], self.ids[piece] = self.library.get_score(i), i
        if None in self.byte_ids:
            raise ValueError("the model has no byte fallback")
        #: what each id decodes to, and its digits
        self.raw = [bytes([int(p[1:-1], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.digits = [str(i) for i in range(size)]
        #: characters that stand side by side in some piece; a text may be cut between all others
        self.joined = {pair for piece in self.scores for pair in zip(piece, piece[1:])}
        self.verify = verify
        self.parts = Remembered()
        self.words = Remembered()

    def _agenda(self, text: str) -> list[int]:
        """Merge the symbols of one part."""
        symbols: list = list(text)
        scores, n = self.scores, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            both = symbols[i] + symbols[i + 1]
            if both in scores:
                agenda.append((-scores[both], i, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            if symbols[i] is None or (j := after[i]) == n or symbols[i] + symbols[j] != both:
                continue  # one of the two has merged with another meanwhile
            symbols[i], symbols[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (right := both + symbols[k]) in scores:
                    heapq.heappush(agenda, (-scores[right], i, right))
            if (h := before[i]) >= 0 and (left := symbols[h] + both) in scores:
                heapq.heappush(agenda, (-scores[left], h, left))
        out: list[int] = []
        for symbol in symbols:
            if symbol is not None:
                known = self.ids.get(symbol)
                out.extend([known] if known is not None else [self.byte_ids[b] for b in symbol.encode()])
        return out

    def _split(self, text: str) -> list[str]:
        joined, at, out = self.joined, 0, []
        for i in range(1, len(text)):
            if (text[i - 1], text[i]) not in joined:
                out.append(text[at:i])
                at = i
        out.append(text[at:])
        return out

    def _decode(self, ids: list[int]) -> str:
        """The text of ids with its leading space mark kept: bytes in a row are read as UTF-8."""
        return b"".join([self.raw[i] for i in ids]).decode()

    def _new_words(self, words: list[str]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of words, each with its leading space marks."""
        split = [self._split(w) for w in words]
        parts = self.parts.fill({p for s in split for p in s}, lambda new: [self._agenda(p) for p in new])
        ids = [[i for p in s for i in parts[p]] for s in split]
        decoded = [self._decode(x) for x in ids]
        if self.verify:
            bare = [w[1:].replace(SPACE, " ") for w in words]
            if (theirs := self.library.encode([b or " " for b in bare], num_threads=1)) != [x if b else self._both_spaces() for x, b in zip(ids, bare)]:
                wrong = next(w for w, b, x, y in zip(words, bare, ids, theirs) if b and x != y)
                raise ValueError(f"ids differ from the library's for {wrong!r}")
            if self.library.decode(ids, num_threads=1) != [d[1:] for d in decoded]:
                raise ValueError("a decoded text differs from the library's")
        return [(",".join([self.digits[i] for i in x]), d) for x, d in zip(ids, decoded)]

    def _both_spaces(self) -> list[int]:
        return self._agenda(SPACE * 2)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        words = [self._cut(t) for t in texts]
        known = self.words.fill({w for ws in words for w in ws}, self._new_words)
        out = []
        for ws in words:
            got = [known[w] for w in ws]
            ids = ",".join([x[0] for x in got])
            out.append((ids.count(",") + 1 if ids else 0, ids, "".join([x[1] for x in got])[1:]))
        return out

    @staticmethod
    def _cut(text: str | None) -> list[str]:
        """Words with their leading space marks; a run of marks stays with the word behind it."""
        if not text:
            return []
        if text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            return [SPACE + w for w in text.split(" ")]
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", SPACE + text.replace(" ", SPACE))


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, verify: bool = True) -> DataFrame:
    """Per row: id_col, n_tokens, ids (array, if asked for), decoded, ids_sha256 and decoded_sha256."""

    def make():
        codec = per_worker(("pieces", model_file, verify), lambda: PieceCodec(model_file, verify))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = codec.encode_batch(batch.column(1).to_pylist())
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array([g[0] for g in got], pa.int64()), "ids_sha256": pa.array([sha(g[1]) for g in got], pa.string()), "decoded_sha256": pa.array([sha(g[2]) for g in got], pa.string())}
            if with_ids:
                columns["ids"] = pa.array([[int(x) for x in g[1].split(",")] if g[1] else [] for g in got], pa.list_(pa.int32()))
                columns["decoded"] = pa.array([g[2] for g in got], pa.string())
            return pa.RecordBatch.from_pydict(columns)

        return apply

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, schema)
