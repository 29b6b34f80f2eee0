"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A sequence of pieces is the merge result of a text exactly if every two
adjacent pieces, taken alone, re-merge to themselves. So no merging is done
over a text: pieces are tried longest first (Aho-Corasick matches), each is
kept if it is compatible with the piece before it, and a bitfield remembers
the positions from which no continuation exists.

Facts of the vocabulary, found or checked when a model is loaded, cut a text
into chunks that are encoded on their own (and cached, since words recur): no
piece continues over a space mark that follows another character, none holds a
control character such as a line end, and some signs never join a letter before them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, utf8

SPACE = "▁"
#: A text is cut between a letter and a sign if no piece holds such a pair.
LETTER, SIGNS = "[A-Za-z\u00c0-\u024f]", ",.;:!?|#$%&*()"
NOT_MERGED = (float("-inf"), -1)
#: Bytes that a worker's cache of encoded chunks and its cache of pairs may take; results don't depend on them.
#: They outlive a task, as the model does: words recur, and without them encoding takes twice the time.
CHUNK_BYTES, PAIR_BYTES = 128 << 20, 48 << 20
#: Positions of a chunk whose matches are held at once, and how many such blocks.
BLOCK, BLOCKS_HELD = 4096, 8
#: Output batches are handed on at about this many bytes.
BATCH_BYTES = 8 << 20


class BpeModel:
    """The vocabulary of a SentencePiece model of the merge type, with its encoder and decoder.

    Models that normalise texts, treat white space as a suffix or add no
    leading space are refused (ValueError).
    """

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.score: dict[str, tuple[float, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.surface: list[bytes] = []
        self.is_byte: list[bool] = []
        self.hidden: set[int] = set()
        self.trie = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.is_byte.append(sp.is_byte(i))
            if sp.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.surface.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i):
                self.hidden.add(i)
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.score[piece] = (sp.get_score(i), i)
                self.surface.append(piece.replace(SPACE, " ").encode())
                self.trie.add_word(piece, (len(piece), i, piece))
        self.trie.make_automaton()
        self.longest = max(map(len, self.score), default=1)
        self.chunks = Bounded(lambda chunk: array("I", self._backtrack(chunk)).tobytes(), CHUNK_BYTES, each=170)
        self.pairs = Bounded(self.compatible, PAIR_BYTES, each=160)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece continues over a space mark")
        alone = "".join(re.escape(chr(c)) for c in range(32) if not any(chr(c) in p for p in self.score))
        before = {y for p in self.score for x, y in zip(p, p[1:]) if re.match(LETTER, x)}
        ends = re.escape("".join(c for c in SIGNS if c not in before))
        self._cut = re.compile(f"[{alone}]|{SPACE}*{LETTER}+(?=[{ends}])|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        for probe in ("", " ", "a  b", "ﬁ éé\n\tx", "  lead and trail  ", "▁ 7421 --", "日本\U0001f642"):
            if self.encode(probe) != sp.encode(probe) or self.decode(sp.encode(probe)) != sp.decode(sp.encode(probe)):
                raise ValueError("not a merge-type model with plain normalisation and a leading space")

    # -- encoding ---------------------------------------------------------

    def remerge(self, symbols: list[str]) -> list[str]:
        """The merge rule itself: the best-scored adjacent pair first, ties to the left."""
        score = self.score.get
        scores = [score(x + y, NOT_MERGED)[0] for x, y in zip(symbols, symbols[1:])]
        while scores and (best := max(scores)) > NOT_MERGED[0]:
            at = scores.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(symbols[at - 1] + symbols[at], NOT_MERGED)[0]
            if at < len(scores):
                scores[at] = score(symbols[at] + symbols[at + 1], NOT_MERGED)[0]
        return symbols

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether two pieces re-merge to themselves; the left one is empty before a first piece."""
        left, right = pair
        return self.remerge([*left, *right]) == ([left, right] if left else [right])

    def _matches(self, chunk: str, low: int, high: int) -> list[list[tuple[int, int, str]]]:
        """The pieces that begin at each position from low to high, by growing length."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in range(high - low)]
        for end, hit in self.trie.iter(chunk, low, min(len(chunk), high + self.longest - 1)):
            if (start := end - hit[0] + 1) < high:
                found[start - low].append(hit)
        return found

    def _backtrack(self, chunk: str) -> list[int]:
        n, pairs = len(chunk), self.pairs
        matches = self._matches(chunk, 0, n) if n <= BLOCK else _Blocks(self, chunk)
        failed = bytearray(n // 8 + 1)  # bit p: nothing that follows position p is compatible
        stack: list[tuple[int, int, int, str]] = []  # position, index into its matches, id, piece
        at, before = 0, ""
        options = matches[0]
        choice = len(options) - 1
        while at < n:
            if not options:  # a character outside the vocabulary: its bytes, compatible with all
                stack.append((at, -1, -1, ""))
                at, before = at + 1, ""
            else:
                while choice >= 0:
                    length, piece_id, piece = options[choice]
                    end = at + length
                    if not failed[end >> 3] >> (end & 7) & 1 and pairs[before, piece]:
                        break
                    choice -= 1
                if choice >= 0:
                    stack.append((at, choice, piece_id, piece))
                    at, before = end, piece
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                    at, choice, _, _ = stack.pop()
                    while choice < 0:
                        failed[at >> 3] |= 1 << (at & 7)
                        at, choice, _, _ = stack.pop()
                    choice -= 1
                    options, before = matches[at], stack[-1][3] if stack else ""
                    continue
            if at < n:
                options = matches[at]
                choice = len(options) - 1
        ids: list[int] = []
        for at, _, piece_id, _ in stack:
            if piece_id >= 0:
                ids.append(piece_id)
            else:
                ids.extend([self.byte_id[b] for b in chunk[at].encode()])
        return ids

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        return b"".join(map(self.chunks.__getitem__, self._cut.findall(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    # -- decoding ---------------------------------------------------------

    def decode(self, ids) -> str:
        """Control ids vanish, byte ids join to characters (a byte that is part of
        none becomes U+FFFD), and the leading space goes once."""
        surface = self.surface
        joined = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if i not in self.hidden), None)
        if first is not None and not self.is_byte[first] and joined[:1] == b" " and first != self.unk:
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(joined):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(joined[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                at += size
            return "".join(out)


class _Blocks:
    """The matches of a long chunk, made in blocks when they are first asked for."""

    def __init__(self, model: BpeModel, chunk: str):
        self.model, self.chunk, self.blocks = model, chunk, {}

    def __getitem__(self, at: int) -> list[tuple[int, int, str]]:
        block, offset = divmod(at, BLOCK)
        if block not in self.blocks:
            if len(self.blocks) >= BLOCKS_HELD:
                self.blocks.clear()
            low = block * BLOCK
            self.blocks[block] = self.model._matches(self.chunk, low, min(len(self.chunk), low + BLOCK))
        return self.blocks[block][offset]


_loaded: dict[int, BpeModel] = {}


def _model(shipped: Broadcast) -> BpeModel:
    """One model for each worker process and broadcast."""
    key = hash(shipped.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BpeModel(shipped.value)
    return _loaded[key]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """Each row's exact ids, and the text that the ids decode to.

    Returns `id_col`, token_ids (binary: the ids as little-endian unsigned
    32-bit integers), n_tokens (long) and decoded (string). Rows stay as they
    are: one for each input row, repeated ids included, and a null id stays
    null. A null text is encoded as the empty one, which has only the begin
    and end ids. Texts of any length are encoded whole. Other columns are not
    read. The model (a few hundred KB) is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shipped)
        head = array("I", [model.bos] if begin else []).tobytes()
        tail = array("I", [model.eos] if end else []).tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, size, ids, decoded = 0, 0, [], []
            for i in range(batch.num_rows):
                packed = head + model.packed(texts[i].as_py().decode(errors="replace")) + tail
                ids.append(packed)
                decoded.append(model.decode(array("I", packed)))
                size += 2 * len(packed)
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [id_col, "token_ids", "decoded"])
                    start, size, ids, decoded = i + 1, 0, [], []

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, token_ids binary, decoded string")
    return out.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))
