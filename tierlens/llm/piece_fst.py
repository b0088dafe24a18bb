"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` turns a public SentencePiece model into a transducer that is
the composition of the normaliser (the model's character map, which rewrites
the longest match at each position; spaces that it removes or puts in front;
space to U+2581), the pieces and the byte fallback.  An input composed with it
is a lattice over character positions; the tokens are its shortest path in the
tropical semiring.

* Unigram models weigh an arc by the negative score of its piece; a character
  that is no piece has an arc whose weight is 10 above the worst piece's.
* BPE models have no arc weights of their own.  Here the piece transducer is
  composed with an adjacency acceptor: an arc after another has weight 0 if
  merging the two pieces' characters by rank gives these two pieces again,
  infinity otherwise.  A sequence of pieces is the one that merging yields
  exactly if all its neighbours are so compatible, so one path of finite
  weight is left at every position.  (Merges within a prefix don't depend on
  what follows until one crosses the border, and the first to cross it
  involves only the two pieces beside it.)

No piece has U+2581 after another character, and some characters (commas, say)
stand in no piece after a letter, so the lattice of a text falls apart there;
the shortest path is the paths of these words in a row.  The distinct words of
some megabytes are looked up once, and their paths are put in the places of the
words as arrays; each worker keeps the paths of words that it found more than
once.  Encoding is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import gc
import re
import struct
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fresh, give_back, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LETTER = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: What stands between words while a text is cut into them.
CUT = "\x1f"
#: Paths that a worker keeps, twice as many for a while; adjacencies that it keeps.
KEPT, KEPT_PAIRS = 120_000, 400_000
#: Bytes of text whose distinct words are looked up at once.
SLICE = 4 << 20
#: What a character without a piece weighs above the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
RESULT = "struct<ids:array<int>,n_tokens:int,round_trip:boolean>"


@dataclass
class Transducer:
    pieces: dict[str, int]
    weight: dict[str, float]
    text: list[bytes]
    names: list[str]
    sizes: list[int]
    byte_ids: list[int]
    unknown: int
    dummy_prefix: bool
    bpe: bool
    automaton: object
    word: re.Pattern
    uncovered: float
    closing: str  # matches a letter and a character that no piece has after it
    mapping: dict[str, str] = field(default_factory=dict)
    spot: re.Pattern | None = None  # where a key of the mapping may begin
    trims: bool = False
    paths: dict[str, tuple[int, ...]] = field(default_factory=dict)
    older: dict[str, tuple[int, ...]] = field(default_factory=dict)
    adjacent: dict[int, bool] = field(default_factory=dict)
    derived: dict[str, tuple[bool, bool, dict[str, tuple[str, str]]]] = field(default_factory=dict)

    def rewritten(self, text: str) -> str:
        """*text* by the character map, the longest key at each position first, and without the spaces that the model removes."""
        if self.spot is not None:
            out, at, longest = [], 0, max(map(len, self.mapping))
            while (m := self.spot.search(text, at)) is not None:
                start = m.start()
                key = next((k for n in range(longest, 0, -1) if (k := text[start : start + n]) in self.mapping), None)
                if key is None:
                    out.append(text[at : start + 1])
                    at = start + 1
                else:
                    out += text[at:start], self.mapping[key]
                    at = start + len(key)
            text = "".join(out) + text[at:] if out else text
        if self.trims:
            text = re.sub(" {2,}", " ", text).strip(" ").rstrip(" " + SPACE)
        return text

    def normalise(self, text: str) -> str:
        """Rewritten, with spaces as U+2581 and one more in front if the model says so; what is empty stays empty."""
        return self._spaced(self.rewritten(text))

    def _spaced(self, text: str) -> str:
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def merged(self, chars: str) -> list[str]:
        """The pieces that merging neighbours by rank leaves: best score first, leftmost on ties."""
        parts = list(chars)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                w = self.weight.get(parts[i] + parts[i + 1])
                if w is not None and (best is None or w < best):
                    best, at = w, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def derivation(self, piece: str) -> tuple[bool, bool, dict[str, tuple[str, str]]]:
        """(merging its characters gives the piece, each merge ranks after the last, the merges)."""
        found = self.derived.get(piece)
        if found is None:
            parts, made, ranks = list(piece), {}, []
            while len(parts) > 1:
                best = min(((self.weight[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in self.weight), default=None)
                if best is None:
                    break
                i = best[1]
                made[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
                ranks.append(best[0])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self.derived[piece] = (len(parts) == 1, all(a < b for a, b in zip(ranks, ranks[1:])), made)
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether the adjacency acceptor has an arc for *right* after *left* ("" before the first).

        Where both pieces' merges come in rank order the two are taken apart
        again, the later merge first; they fit unless at some time the symbols
        at the border would merge before either's own next merge.  On ties
        the left one comes first.  Other pieces are merged anew.
        """
        whole, steady, parts = self.derivation(right)
        known = whole
        if left and whole:
            _, steady_left, left_parts = self.derivation(left)
            if steady and steady_left:
                weight, none = self.weight, float("inf")
                x, y, end_x, end_y = left, right, none, none
                while known:
                    w = weight.get(x + y, none)
                    if w < end_x and w <= end_y and w < none:
                        known = False
                    made_x, made_y = (weight[x] if x in left_parts else -1.0), (weight[y] if y in parts else -1.0)
                    if made_x < 0 and made_y < 0:
                        break
                    if made_x > made_y:
                        end_x, x = made_x, left_parts[x][1]
                    else:
                        end_y, y = made_y, parts[y][0]
            else:
                known = self.merged(left + right) == [left, right]
        return known

    def fallback(self, char: str) -> tuple[int, ...]:
        """The byte arcs of a character that no piece covers, or the unknown piece."""
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")) if self.byte_ids else (self.unknown,)

    def fits(self, left: int, right: int) -> bool:
        """:func:`compatible` of two labels, kept; characters without a piece are labelled behind the pieces, a word's start by -1."""
        name = lambda i: "" if i < 0 else self.names[i] if i < len(self.names) else chr(i - len(self.names))
        if len(self.adjacent) >= KEPT_PAIRS:
            self.adjacent.clear()
        known = self.adjacent[left << 20 | right] = self.compatible(name(left), name(right))
        return known

    def _merged(self, word: str) -> list[int | None]:
        """The label of the last arc of the one path to each position; None for a character that no piece covers.

        The arcs are the matches of the piece automaton, by their end, the longest first.
        """
        get, other = self.adjacent.get, len(self.names)
        last: list[int | None] = [None] * (len(word) + 1)
        last[0] = -1
        for at, (label, size, _) in self.automaton.iter(word):
            if last[at + 1] is None:
                start = at + 1 - size
                left = last[start]
                if left is None:
                    left = last[start] = other + ord(word[start - 1])
                known = get(left << 20 | label)
                if known or known is None and self.fits(left, label):
                    last[at + 1] = label
        return last

    def _cheapest(self, word: str) -> list[int | None]:
        """As :func:`_merged`, of the path of least weight to each position; on ties the longest last arc.

        A character that is no piece has an arc of its own.  (Of paths of equal
        weight the library takes either, as its single floats happen to round.)
        """
        n, uncovered = len(word), self.uncovered
        last, cost = [None] * (n + 1), [0.0] + [float("inf")] * n
        done = 0

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if word[done - 1] not in self.pieces and cost[done - 1] + uncovered < cost[done]:
                    last[done], cost[done] = None, cost[done - 1] + uncovered

        for at, (label, size, weight) in self.automaton.iter(word):
            settle(at)
            if (total := cost[at + 1 - size] + weight) < cost[at + 1]:
                last[at + 1], cost[at + 1] = label, total
        settle(n)
        return last

    def shortest(self, word: str) -> tuple[int, ...]:
        """Labels of the shortest path of the lattice of normalised *word*."""
        last = self._merged(word) if self.bpe else self._cheapest(word)
        sizes, other, out, end = self.sizes, len(self.names), [], len(word)
        while end:
            label = last[end]
            if label is None or label >= other:
                out.extend(reversed(self.fallback(word[end - 1])))
                end -= 1
            else:
                out.append(label)
                end -= sizes[label]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return self._encoded(self.rewritten(text))

    def _encoded(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.word.findall(self._spaced(text)):
            out += self.shortest(word)
        if not self.byte_ids:  # unknown characters in a row are one token
            out = [x for k, x in enumerate(out) if x != self.unknown or not k or out[k - 1] != x]
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets, whether decoding gives each text again) of texts without nulls."""
        if self.spot is not None or self.trims:
            texts = pa.array([self.rewritten(t) for t in texts.to_pylist()], texts.type)
        odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, SPACE), pc.match_substring(texts, CUT))))
        odd = odd.to_numpy(zero_copy_only=False) | (not self.dummy_prefix)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.if_else(pa.array(odd), "", texts), " ", CUT + SPACE)
        if self.closing:
            cut = pc.replace_substring_regex(cut, self.closing, rf"\1{CUT}\2")
        words = pc.split_pattern(cut, CUT)  # of odd and empty texts one word ""; the first word still lacks its prefix
        begin = words.offsets.to_numpy().astype(np.int64)
        first = np.zeros(int(begin[-1]), bool)
        first[begin[:-1]] = ~(odd | empty)
        flat_words = words.flatten()
        coded = pc.if_else(pa.array(first), pc.binary_join_element_wise(SPACE, flat_words, ""), flat_words).dictionary_encode()
        units, place = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        paths, ok = [], []
        get, older, text = self.paths.get, self.older.get, self.text
        for word, often in zip(units, (np.bincount(place, minlength=len(units)) > 1).tolist()):
            ids, good = get(word), True
            if ids is None:
                ids = older(word)
                if ids is None:
                    ids = self.shortest(word)
                    good = b"".join([text[i] for i in ids]) == word.replace(SPACE, " ").encode()
                if often and good and len(word) <= 64:
                    if len(self.paths) >= KEPT:
                        self.older, self.paths = self.paths, {}
                        get, older = self.paths.get, self.older.get
                    self.paths[word] = ids
            paths.append(ids)
            ok.append(good)
        for t in np.flatnonzero(odd & ~empty):
            place[begin[t]] = len(paths)
            own = texts[int(t)].as_py()
            paths.append(self._encoded(own))
            ok.append(self.decode(paths[-1]) == own.replace(SPACE, " "))
        size = np.array([len(x) for x in paths], np.int64)
        start = np.cumsum(size) - size
        flat_ids = np.fromiter((i for x in paths for i in x), np.int32, int(size.sum()))
        count = size[place]
        ends = np.cumsum(count)
        ids = flat_ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[place] - (ends - count), count)]
        at = np.concatenate([[0], ends])[begin]
        good = np.array(ok, bool)[place]
        whole = np.concatenate([[0], np.cumsum(~good)])
        fine = whole[begin[1:]] == whole[begin[:-1]]
        if not self.byte_ids and len(ids):  # unknown characters in a row are one token
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            again[at[:-1][at[:-1] < len(ids)]] = False
            at = at - np.concatenate([[0], np.cumsum(again)])[at]
            ids = ids[~again]
        for t in np.flatnonzero(~fine & ~odd):  # words that don't come back alone
            fine[t] = self.decode(ids[at[t] : at[t + 1]].tolist()) == texts[int(t)].as_py()
        return ids, at, fine

    def decode(self, ids: list[int]) -> str:
        """The normalised text of *ids*: bytes of pieces and byte arcs, invalid UTF-8 replaced, without the dummy prefix; control pieces give nothing."""
        raw = b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")
        return raw.lstrip(" ") if self.trims else raw[1:] if self.dummy_prefix and raw.startswith(" ") else raw


def boundaries(pieces: dict[str, int]) -> tuple[re.Pattern, str]:
    """Matches the words of normalised text, the longest parts that pieces can cross; and the places within a word of spaced text where another begins."""
    follows = {p[i] for p in pieces for i in range(1, len(p)) if re.match(f"[{LETTER}]", p[i - 1])}
    closing = "".join(f"\\x{c:02x}" for c in range(127) if not chr(c).isalnum() and chr(c) not in follows and chr(c) not in " " + CUT)
    inner = f"[^{SPACE}{closing}]" + (f"|(?<![{LETTER}])[{closing}]" if closing else "")
    first = f"[{closing}]" if closing else "(?!)"
    return re.compile(f"{SPACE}+(?:{inner})*|(?:{inner})+|{first}(?:{inner})*"), f"([{LETTER}])([{closing}])" if closing else ""


def character_map(blob: bytes) -> dict[str, str]:
    """Keys and replacements of a model's compiled character map: a double-array trie over bytes, then its zero-ended values."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, values = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    below = lambda u: (u >> 10) << ((u & 512) >> 6)
    out: dict[str, str] = {}
    keys, nodes, at = [b""], units[:1], below(units[:1])
    labels = np.arange(1, 256)
    while len(keys):  # a level of the trie after the other
        for k in np.flatnonzero(nodes >> 8 & 1).tolist():
            value = int(units[at[k]]) & 0x7FFFFFFF
            out[keys[k].decode()] = values[value : values.index(0, value)].decode()
        next_ = at[:, None] ^ labels
        there = np.where(next_ < len(units), units[np.minimum(next_, len(units) - 1)], 0)
        parent, label = np.nonzero(there & 0x800000FF == labels)
        keys = [keys[p] + bytes([c]) for p, c in zip(parent.tolist(), labels[label].tolist())]
        nodes = there[parent, label]
        at = next_[parent, label] ^ below(nodes)
    return out


def spots(mapping: dict[str, str]) -> re.Pattern | None:
    """Matches the places where a key may begin: a key of one character, or the first two of a longer one."""
    if not mapping:
        return None
    of = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
    parts = [of(k) for k in [{k for k in mapping if len(k) == 1}] if k]
    longer = [k for k in mapping if len(k) > 1]
    if longer:
        parts.append(f"{of({k[0] for k in longer})}(?={of({k[1] for k in longer})})")
    return re.compile("|".join(parts))


def compile_model(path: str) -> Transducer:
    """Read a SentencePiece model file of the unigram or BPE kind."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, model.trainer_spec.model_type
    if not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or kind not in (1, 2):
        raise ValueError("only unigram and BPE models that put U+2581 in front of words are supported")
    pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
    weight = {p.piece: -p.score for p in model.pieces if p.type in (NORMAL, USER)}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece has a space after another character")
    automaton = ahocorasick.Automaton()
    for piece, label in pieces.items():
        automaton.add_word(piece, (label, len(piece), weight[piece]))
    automaton.make_automaton()
    worst, mapping = max((-p.score for p in model.pieces if p.type == NORMAL), default=0.0), character_map(norm.precompiled_charsmap)
    ids = {p.piece: i for i, p in enumerate(model.pieces)}
    byte_ids = [ids[f"<0x{b:02X}>"] for b in range(256)] if any(p.type == BYTE for p in model.pieces) else []
    text = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type in (CONTROL, UNUSED) else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
    names = [p.piece for p in model.pieces]
    word, closing = boundaries(pieces)
    return Transducer(pieces, weight, text, names, [len(x) for x in names], byte_ids, next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), 0), norm.add_dummy_prefix, kind == 2, automaton, word, worst + UNKNOWN_PENALTY, closing, mapping, spots(mapping), norm.remove_extra_whitespaces)


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The compiled model of this process."""
    if path not in _COMPILED:
        _COMPILED[path] = compile_model(path)
    return _COMPILED[path]


def encode(text: Column, path: str) -> Column:
    """Struct of ids, n_tokens and round_trip (whether decoding gives the text again) for a text column; null for null, no ids for "".

    A text that holds U+2581 itself decodes to spaces there, as with any
    SentencePiece model, so round_trip compares after that replacement, and
    after the model's character map and removal of spaces if it has them.
    Texts of any length are encoded in whole.  *path* must be readable by the
    executors.
    """

    def run(texts: pa.Array) -> pa.Array:
        fst = transducer(path)
        ids, sizes, ok = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        gc.disable()  # many small tuples live on; none is in a cycle
        try:
            for part in slices(texts, SLICE):
                i, at, fine = fst.encode_all(part.fill_null(""))
                ids.append(i)
                sizes.append(np.diff(at))
                ok.append(fine)
        finally:
            gc.enable()
            give_back()
        n = np.concatenate(sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids)))
        mask = pa.array(~np.array(texts.is_valid(), bool)) if texts.null_count else None
        return pa.StructArray.from_arrays([lists, pa.array(n, pa.int32()), pa.array(np.concatenate(ok))], names=["ids", "n_tokens", "round_trip"], mask=mask)

    return F.arrow_udf(run, RESULT)(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an ids column; null for null or where an id is out of range, "" for no ids."""

    def run(lists: pa.Array) -> pa.Array:
        fst = transducer(path)
        n = len(fst.text)
        return pa.array([None if x is None or any(i is None or not 0 <= i < n for i in x) else fst.decode(x) for x in lists.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)


def tokenise(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """*docs* with ``ids``, ``n_tokens`` and ``round_trip`` (see :func:`encode`); names that clash get underscores appended."""
    tmp = fresh(docs, "tokens")
    out = by_bytes(docs).withColumn(tmp, encode(F.col(text), path))
    return out.withColumns({fresh(docs, c): F.col(tmp)[c] for c in ("ids", "n_tokens", "round_trip")}).drop(tmp)
