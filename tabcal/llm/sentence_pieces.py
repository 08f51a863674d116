"""SentencePiece encoding and decoding: one forward pass over a trie of the distinct marked words of many texts."""

from __future__ import annotations

import hashlib
import re
from array import array

from pyspark.sql import DataFrame

from tabcal.llm.common import append_columns, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of encoded words, and of tried pairs of pieces, that a task remembers; beyond it a memory starts anew (results stay the same).
REMEMBERED_BYTES = 48 << 20
#: Bytes that a remembered word takes beside its characters and ids, and that a pair takes.
WORD_BYTES, PAIR_BYTES = 240, 130
#: Bytes of text whose distinct words are walked at once: more texts share more prefixes.
WALKED_BYTES = 2 << 20
_SHIFT = 22  # a pair of piece numbers as one integer; characters without a piece are numbered after all pieces
_NONE = (1 << _SHIFT) - 1


class _Packed(dict):
    """Ids (32-bit, native order) by piece number; a character that is no piece gives the ids of its UTF-8 bytes."""

    def __init__(self, n_names: int, bytes_from: int):
        super().__init__((i, array("i", [i]).tobytes()) for i in range(n_names))
        self.n_names, self.bytes_from = n_names, bytes_from

    def __missing__(self, number: int) -> bytes:
        return array("i", [self.bytes_from + b for b in chr(number - self.n_names).encode()]).tobytes()


class Pieces:
    """Vocabulary of a SentencePiece model with byte fallback, and the forward pass over words.

    kind "bpe": a prefix of a word has one encoding, whose last piece is the only one that merging leaves apart from the
    last piece of the prefix before it; a path is a Viterbi path whose transitions cost nothing or everything. So a prefix
    needs only its last piece. kind "unigram": the best sum of scores, a prefix needs its score and last piece. Either
    way the forward state of a prefix is shared by all words that begin with it. The pieces that end at a place are
    read off an automaton of all pieces, whose state is part of the forward state.
    """

    def __init__(self, names: list[str], scores: list[float], special: set[int], bytes_from: int, kind: str = "bpe"):
        self.kind, self.names, self.bytes_from = kind, names, bytes_from
        self.ids = {name: i for i, name in enumerate(names) if i not in special}
        self.scores = {name: scores[i] for name, i in self.ids.items()}
        self.by_id = scores
        if any(re.search(f"[^{MARK}]{MARK}", name) for name in self.ids):
            raise ValueError("pieces that hold a word border inside are not supported")
        self.unknown_score = min(self.scores.values(), default=0.0) - 10
        inside = sorted({c for name in self.ids if len(name) > 1 for c in name} - {MARK})
        joined = "".join(map(re.escape, inside))
        # Characters that occur in no longer piece are words of their own: nothing merges across them.
        self.word = re.compile(f"{MARK}*[{joined}]+|{MARK}+|." if inside else f"{MARK}+|.", re.S)
        self.known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._known_bytes = 0
        self._apart: dict[int, bool] = {}
        self._packed = _Packed(len(names), bytes_from)
        self.next: list[dict[str, int]] = []
        table = list(names)
        for b in range(256):
            table[bytes_from + b] = chr(b) if b < 128 else None
        self._table = [None if name is None else name.replace(MARK, " ") for name in table]

    def _build(self) -> None:
        """Automaton of the pieces: per state its next states, its failure state, and the (length, id) of pieces that end there,
        longest first."""
        self.next, self.fail, self.ending = [{}], [0], [()]
        final = {0: None}
        for name, i in self.ids.items():
            state = 0
            for c in name:
                after = self.next[state].get(c)
                if after is None:
                    after = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ending.append(())
                state = after
            final[state] = (len(name), i)
        level = list(self.next[0].values())
        while level:
            below = []
            for state in level:
                own = final.get(state)
                self.ending[state] = ((own,) if own else ()) + self.ending[self.fail[state]]
                for c, after in self.next[state].items():
                    f = self.fail[state]
                    while f and c not in self.next[f]:
                        f = self.fail[f]
                    self.fail[after] = self.next[f].get(c, 0)
                    below.append(after)
            level = below

    @classmethod
    def load(cls, model: bytes, kind: str = "bpe") -> Pieces:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        special = {i for i in range(n) if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        return cls([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], special, p.piece_to_id("<0x00>"), kind)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging by its definition: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _name(self, number: int) -> str:
        return "" if number == _NONE else self.names[number] if number < len(self.names) else chr(number - len(self.names))

    def apart(self, left: int, right: int) -> bool:
        """Whether merging leaves two neighbouring pieces as they are."""
        if len(self._apart) * PAIR_BYTES > REMEMBERED_BYTES:
            self._apart.clear()
        a, b = self._name(left), self._name(right)
        found = self._apart[left << _SHIFT | right] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids (32-bit, native order) of distinct words: in sorted order each word continues at the prefix it shares with the
        one before, as a depth-first walk over their trie does."""
        if not self.next:
            self._build()
        return (self._encode_bpe if self.kind == "bpe" else self._encode_unigram)(sorted(words))

    def _encode_bpe(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        following, fail, ending, known, count, packed = self.next, self.fail, self.ending, self._apart.get, len(self.names), self._packed
        longest = max(map(len, words), default=0) + 1
        states, last, sizes, previous = [0] * longest, [_NONE] * longest, [0] * longest, ""  # per prefix: automaton state, last piece, its length
        for word in words:
            at = 0
            for x, y in zip(word, previous):
                if x != y:
                    break
                at += 1
            state = states[at]
            for c in word[at:]:
                after = following[state].get(c)
                while after is None:
                    if not state:
                        after = 0
                        break
                    state = fail[state]
                    after = following[state].get(c)
                state = after
                at += 1
                for size, number in ending[state]:
                    left = last[at - size]
                    fits = known(left << _SHIFT | number)
                    if fits or fits is None and self.apart(left, number):
                        break
                else:  # a character that is no piece stands for itself
                    size, number = 1, count + ord(c)
                    if not self.apart(last[at - 1], number):
                        raise ValueError(f"no encoding of {word[:at]!r}")
                states[at], last[at], sizes[at] = state, number, size
            path = []
            while at:
                path.append(packed[last[at]])
                at -= sizes[at]
            out[word] = b"".join(path[::-1])
            previous = word
        return out

    def _encode_unigram(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        states, last, sizes, best, previous = [0], [_NONE], [0], [0.0], ""
        for word in words:
            shared = 0
            for x, y in zip(word, previous):
                if x != y:
                    break
                shared += 1
            del states[shared + 1:], last[shared + 1:], sizes[shared + 1:], best[shared + 1:]
            state = states[shared]
            for i in range(shared, len(word)):
                c = word[i]
                while state and c not in self.next[state]:
                    state = self.fail[state]
                state = self.next[state].get(c, 0)
                options = [(best[i + 1 - size] + self.by_id[number], number, size) for size, number in self.ending[state]]
                if not options or options[-1][2] != 1:
                    options.append((best[i] + self.unknown_score, len(self.names) + ord(c), 1))
                score, number, size = max(options)
                states.append(state)
                last.append(number)
                sizes.append(size)
                best.append(score)
            out[word] = self._path(last, sizes, len(word))
            previous = word
        return out

    def _path(self, last: list[int], sizes: list[int], at: int) -> bytes:
        numbers = []
        while at:
            numbers.append(last[at])
            at -= sizes[at]
        return self._bytes(numbers[::-1])

    def _bytes(self, numbers: list[int]) -> bytes:
        return b"".join([self._packed[n] for n in numbers])

    def mark(self, text: str) -> list[str]:
        """The marked words of a text, which has a mark put before it: marks and what follows them, cut at characters that no
        longer piece holds."""
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def forget(self) -> None:
        """Give up the words and pairs remembered."""
        self.known, self._older, self._known_bytes = {}, {}, 0
        self._apart.clear()

    def _remember(self, parts: set[str]) -> None:
        """Have the ids of all marked parts of texts in `known`. Parts that were not asked for while it was filled to its bound twice
        are forgotten."""
        if self._known_bytes > REMEMBERED_BYTES // 2:
            self.known, self._older, self._known_bytes = {}, self.known, 0
        older, known, find = self._older, self.known, self.word.findall
        fresh, cut = [], {}
        added = 0
        for part in parts.difference(known):
            ids = older.get(part)
            if ids is None:
                words = find(part)
                if len(words) > 1:
                    cut[part] = words
                else:
                    fresh.append(part)
                continue
            known[part] = ids
            added += WORD_BYTES + 4 * len(part) + len(ids)
        coded = self.encode_words(set(fresh).union(*cut.values()) if cut else fresh)
        for part in fresh:
            ids = known[part] = coded[part]
            added += WORD_BYTES + 4 * len(part) + len(ids)
        for part, words in cut.items():
            ids = known[part] = b"".join([coded[w] for w in words])
            added += WORD_BYTES + 4 * len(part) + len(ids)
        self._known_bytes += added

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Texts with single spaces are split before these; a part is a mark and what follows it."""
        parts = [
            (MARK + t.replace(" ", " " + MARK)).split(" ") if t and MARK not in t and "  " not in t and t[0] != " " else self.mark(t or "")
            for t in texts]
        self._remember(set().union(*parts))
        known = self.known
        if self._known_bytes > REMEMBERED_BYTES:  # one slice may be a single very long text
            self.known, self._known_bytes = {}, 0
        return [b"".join([known[x] for x in p]) for p in parts]

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, runs of byte pieces read as UTF-8 (what is not valid becomes U+FFFD), marks to spaces,
        without the space put before the text."""
        ids = ids.tolist() if hasattr(ids, "tolist") else ids
        parts = [self._table[i] for i in ids]
        if None in parts:
            low, out, run = self.bytes_from, [], bytearray()
            for i, part in zip(ids, parts, strict=True):
                if part is None:
                    run.append(i - low)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(part)
            parts = [*out, run.decode("utf-8", "replace")]
        return "".join(parts)[1:]


_loaded: dict[tuple[bytes, str], Pieces] = {}


def _pieces(model: bytes, kind: str) -> Pieces:
    """One per worker and model."""
    key = (hashlib.sha256(model).digest(), kind)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces.load(model, kind)
    return _loaded[key]


def encode_pieces(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids", count_col: str = "n_pieces",
    model: str = MODEL, kind: str = "bpe", digests: bool = False,
) -> DataFrame:
    """docs (or its columns `keep`) with the piece ids of each text, equal to the model's own encoding, and their number.
    With `digests` also ids_sha256 (of the ids, 32-bit little-endian), decoded_sha256 and round_trip (whether the ids' decoded
    text is the text), from the ids of each row.

    Null or empty text: no ids. Each slice of rows has its distinct marked words encoded once, in one walk over their
    trie; texts are then put together from their words. Rows are independent; nothing is shuffled. `model` is a path on
    the driver; its content goes to the tasks.
    """
    pieces = _shared(docs, model, kind)

    def start():
        import numpy as np
        import pyarrow as pa

        coder = pieces()

        def call(texts):
            flat = coder.encode(texts)
            counts = np.array([len(x) // 4 for x in flat], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(flat), dtype=np.int32))
            out = (pa.ListArray.from_arrays(pa.array(offsets), values), counts.tolist())
            if not digests:
                return out
            rows = [np.frombuffer(x, dtype=np.int32) for x in flat]
            decoded = [coder.decode(ids) for ids in rows]
            return (
                *out, [hashlib.sha256(ids.astype("<i4", copy=False).tobytes()).hexdigest() for ids in rows],
                [hashlib.sha256(d.encode()).hexdigest() for d in decoded], [d == (t or "") for d, t in zip(decoded, texts, strict=True)])

        call.close = coder.forget
        return call

    made = f"{ids_col} array<int>, {count_col} bigint" + ", ids_sha256 string, decoded_sha256 string, round_trip boolean" * digests
    return append_columns(docs, [text_col], made, start, keep, WALKED_BYTES)


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """encoded (or its columns `keep`) with the text of its ids; null ids give the empty text."""
    pieces = _shared(encoded, model, "bpe")

    def start():
        coder = pieces()
        return lambda rows: (["" if ids is None else coder.decode(ids) for ids in rows],)

    return append_columns(encoded, [ids_col], f"{text_col} string", start, keep)


def _shared(df: DataFrame, path: str, kind: str):
    with open(path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: _pieces(model.value, kind)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and digests of the ids and of the decoded text, and whether that is the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, keep=["doc_id"], digests=True)


QUERIES = {"op8_sentencepiece": (op8_sentencepiece, None)}
