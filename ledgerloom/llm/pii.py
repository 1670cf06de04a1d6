"""Personal information in free text by a skip-chain conditional random field (p8)."""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii_labels import sample_labels

TYPES = ("name", "email", "phone", "id_number", "address")
#: Label 0 is outside; 1 + 2k begins and 2 + 2k continues a mention of TYPES[k].
N_LABELS = 1 + 2 * len(TYPES)
#: Texts on which the field is fitted at most, drawn by a threshold on the hash of their ids; texts beyond SAMPLE_CHARS characters are not drawn. Finding reads every text whole.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 12_000
BUCKETS = 1 << 17
#: Chains of more words are solved in pieces of so many, each read together with MARGIN words on both sides, over which the influence of a word on another has faded.
PIECE, MARGIN = 2048, 128

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\s]")


class NameFilter:
    """A set of words in a bit field of a fixed size: the same for any number of words, so it can go to every task. A word of the set is always in it; with a million words, one in a hundred others is too."""

    BITS = 1 << 24

    def __init__(self, cells: dict[int, int] | None = None):
        """cells: 64-bit numbers by their place."""
        self.bits = np.zeros(self.BITS // 64, np.uint64)
        for cell, bits in (cells or {}).items():
            self.bits[cell] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)

    @staticmethod
    @lru_cache(maxsize=200_000)
    def places(word: str) -> tuple[int, int]:
        digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
        return int(digest[:6], 16), int(digest[6:12], 16)

    @classmethod
    def of(cls, words) -> NameFilter:
        out = cls()
        for word in words:
            for p in cls.places(word):
                out.bits[p >> 6] |= np.uint64(1 << (p & 63))
        return out

    def __contains__(self, word: str) -> bool:
        return all(int(self.bits[p >> 6]) >> (p & 63) & 1 for p in self.places(word))


# ---- features ----

#: Code points of white space.
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_K = np.uint64(0x9E3779B97F4A7C15)


def _hash(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=200_000)
def _shape(word: str) -> str:
    if word.isdigit():
        return f"9{min(len(word), 12)}"
    if word[0].isalpha():
        return ("X" if len(word) == 1 else "X2" if len(word) == 2 else "XX") if word.isupper() else "Xx" if word[0].isupper() else "x1" if len(word) == 1 else "x"
    return word


@lru_cache(maxsize=200_000)
def _folded(word: str) -> str:
    """Lower case without accents."""
    low = word.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def _sort_of(word: str, given: bool, family: bool) -> int:
    """A coarse class of words, of which features take up to five in a row."""
    if word.isdigit():
        return 10 if len(word) < 4 else 11
    if not word[0].isalpha():
        return {".": 6, "-": 7, ",": 8, "'": 9, "’": 9}.get(word, 14)
    if not word[0].isupper():
        return 13 if len(word) <= 3 else 0
    if given or family:
        return 1 + (1 if given else 0) + (2 if family else 0)
    return 5 if len(word) == 1 else 12 if word.isupper() else 1


class Words:
    """The words of a batch of texts with their features: flat arrays, one row per word. blind: as if no name were known."""

    def __init__(self, texts: list[str], given, family, blind: bool = False):
        # all texts at once: a word never holds white space, and every other character belongs to a word
        whole = "\n".join(texts)
        tokens = TOKEN.findall(whole)
        self.texts, self.tokens = texts, tokens
        n = len(tokens)
        self.rows = np.zeros(len(texts), np.int64)
        if not n:
            self.starts = self.ends = self.owner = np.zeros(0, np.int64)
            self.by_kind, self.by_word, self._link_keys = [], [], []
            return
        codes, kinds = pd.factorize(np.array(tokens, dtype=object))
        kinds = kinds.tolist()
        low = [_folded(k) for k in kinds]
        lengths = np.array([len(k) for k in kinds])[codes]
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        written = np.flatnonzero(~np.isin(points, _SPACES))
        at = written[np.cumsum(lengths) - lengths]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.owner = owner = np.searchsorted(begins, at, "right") - 1
        self.starts = at - begins[owner]
        self.ends = self.starts + lengths
        self.rows = np.bincount(owner, minlength=len(texts))
        joined = np.zeros(n, bool)
        joined[1:] = (self.starts[1:] == self.ends[:-1]) & (owner[1:] == owner[:-1])
        then = np.append(joined[1:], False)  # the next word follows without a blank
        breaks = np.cumsum(points == 10)[at]
        line = np.zeros(n, bool)  # a line begins here
        line[1:] = (breaks[1:] > breaks[:-1]) & (owner[1:] == owner[:-1])

        alpha = np.array([k[0].isalpha() for k in kinds])
        if blind:
            is_given = is_family = np.zeros(len(kinds), bool)
        else:
            names = [k[0].isupper() and len(k) > 1 for k in kinds]
            is_given = np.array([a and k.lower() in given for a, k in zip(names, kinds, strict=True)])
            is_family = np.array([a and k.lower() in family for a, k in zip(names, kinds, strict=True)])
        word = _hash(low)
        shape = _hash([_shape(k) for k in kinds])
        tail = _hash([k[-3:] if len(k) > 4 else "" for k in low])
        sort = np.array([_sort_of(k, g, f) for k, g, f in zip(kinds, is_given, is_family, strict=True)], np.uint64)
        none = len(kinds)  # the kind of a place outside the text
        word, shape, tail, sort = (np.append(x, np.uint64(15)) for x in (word, shape, tail, sort))

        def moved(values: np.ndarray, by: int, empty: int) -> np.ndarray:
            """values of the word `by` places before (or after, if negative) in the same text."""
            out = np.full(n, empty, values.dtype)
            if 0 < by < n:
                out[by:] = np.where(owner[by:] == owner[:-by], values[:-by], out[by:])
            elif 0 < -by < n:
                out[:by] = np.where(owner[-by:] == owner[:by], values[-by:], out[:by])
            return out

        column = count(1)

        def index(values: np.ndarray) -> np.ndarray:
            return (_mix((values.astype(np.uint64) + np.uint64(next(column))) * _K) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)

        before, after, before2, after2 = moved(codes, 1, none), moved(codes, -1, none), moved(codes, 2, none), moved(codes, -2, none)
        # white-space chunks: their first words as neighbours, and the shape of the whole chunk
        chunk = np.cumsum(~joined) - 1
        first = np.flatnonzero(~joined)
        n_chunks = len(first)
        place = np.arange(n) - first[chunk]

        def neighbour(by: int) -> np.ndarray:
            to = chunk + by
            ok = (to >= 0) & (to < n_chunks)
            place_of = first[np.clip(to, 0, n_chunks - 1)]
            return np.where(ok & (owner[place_of] == owner), codes[place_of], none)

        coarse = _hash(["a" if a else f"9{min(len(k), 14)}" if k.isdigit() else k for k, a in zip(kinds, alpha, strict=True)])
        chunk_shape = np.add.reduceat(_mix(coarse[codes] + np.minimum(place, 40).astype(np.uint64) * _K), first)
        alone = np.diff(np.append(first, n)) == 1
        chunk_shape[alone] = 7
        here = chunk_shape[chunk]
        after_chunk = np.append(chunk_shape[1:], np.uint64(3))[chunk]
        # runs of digits with the signs and short capital codes between them
        digit = np.array([k.isdigit() for k in kinds])[codes]
        sign = np.array([k in "+()-./" for k in kinds])[codes]
        code = np.array([a and len(k) <= 2 and k.isupper() for k, a in zip(kinds, alpha, strict=True)])[codes]
        number_after, number_before = moved(digit, -1, False), moved(digit, 1, False)
        closing = np.array([k == ")" for k in kinds])[codes]
        in_run = digit | code | (sign & then & number_after) | (closing & joined & number_before)
        start = in_run.copy()
        start[1:] &= ~in_run[:-1] | (owner[1:] != owner[:-1]) | line[1:]
        run_of = np.cumsum(start) - 1
        sig, spot = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        lead, follow = np.full(n, none), np.full(n, none)
        if in_run.any():
            inside = np.flatnonzero(in_run)
            run = run_of[inside]
            opens = np.flatnonzero(start)
            where = inside - opens[run]
            mixed = _mix(shape[codes[inside]] + (np.minimum(where, 40) * 2 + joined[inside]).astype(np.uint64) * _K)
            edges = np.searchsorted(run, np.arange(len(opens)))
            total = np.add.reduceat(mixed, edges)
            holds = np.add.reduceat(digit[inside].astype(np.int64), edges) > 0
            closes = np.append(edges[1:], len(inside)) - 1
            # the nearest letters before and after a run
            letters = np.flatnonzero(alpha[codes] & ~in_run)
            if len(letters):
                prev = np.searchsorted(letters, opens) - 1
                lead_at = letters[np.maximum(prev, 0)]
                lead_run = np.where((prev >= 0) & (owner[lead_at] == owner[opens]) & (opens - lead_at < 8), codes[lead_at], none)
                ends = inside[closes]
                nxt = np.searchsorted(letters, ends)
                follow_at = letters[np.minimum(nxt, len(letters) - 1)]
                follow_run = np.where((nxt < len(letters)) & (owner[follow_at] == owner[ends]) & (follow_at - ends < 8), codes[follow_at], none)
            else:
                lead_run = follow_run = np.full(len(opens), none)
            keep = holds[run]
            sig[inside[keep]] = total[run[keep]] | np.uint64(1)
            spot[inside[keep]] = np.minimum(where[keep], 20) + 1
            lead[inside[keep]], follow[inside[keep]] = lead_run[run[keep]], follow_run[run[keep]]

        # looked up by the kind of a word here or nearby
        self.by_kind = [
            (codes, [index(word), index(shape), index(tail)]),
            (before, [index(word), index(shape)]),
            (after, [index(word), index(shape)]),
            (before2, [index(word)]),
            (after2, [index(word)]),
            (neighbour(-2), [index(word)]),
            (neighbour(-1), [index(word)]),
            (neighbour(1), [index(word)]),
            (neighbour(2), [index(word)]),
            (neighbour(3), [index(word)]),
            (lead, [index(word)]),
            (follow, [index(word)]),
        ]
        s = [sort[c] for c in (moved(codes, 3, none), before2, before, codes, after, after2, moved(codes, -3, none))]

        def row(a: int, b: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            for x in s[a + 3 : b + 4]:
                out = out * np.uint64(16) + x
            return out

        j = (joined * 4 + then * 2 + line).astype(np.uint64)
        nl = line.astype(np.uint64) + np.uint64(2) * np.append(line[1:], True).astype(np.uint64)
        s0, s1, s2 = shape[before], shape[codes], shape[after]
        self.by_word = [index(x) for x in (
            s[3], row(-1, 0), row(0, 1), row(-1, 1), row(-2, 0), row(0, 2), row(-2, 2), row(-3, 0), row(0, 3),
            _mix(s0) + s1, _mix(s1) + s2, _mix(_mix(s0) + s1) + s2, _mix(s1) + j,
            _mix(here) + np.minimum(place, 15).astype(np.uint64), _mix(here) + word[codes], _mix(after_chunk) + j,
            _mix(sig) + spot, _mix(sig) + word[lead] * (sig != 0), _mix(sig) + word[follow] * (sig != 0), _mix(word[before]) + word[codes], _mix(s[3] * np.uint64(16) + s[2]) + nl, _mix(word[before] + nl) + s[3], _mix(row(-1, 1)) + word[neighbour(-1)],
        )]
        self._link_keys = self._keys_of_links(codes, kinds, low, alpha, owner, moved, none)

    @staticmethod
    def _keys_of_links(codes, kinds, low, alpha, owner, moved, none) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, keys) by sort of link; words of a text with the same key are linked, each with the next one."""
        size = np.array([len(k) for k in kinds])
        capital = np.array([k[0].isupper() for k in kinds])
        folded = pd.factorize(np.array(low, dtype=object))[0]
        named = set(folded[capital & alpha & (size > 3)].tolist())
        linkable = alpha & (size > 3) & np.array([f in named for f in folded.tolist()])
        mine = folded[codes]
        same = np.flatnonzero((linkable & capital)[codes])
        digits = np.flatnonzero(np.array([k.isdigit() and len(k) > 3 for k in kinds])[codes])
        any_case = np.flatnonzero(linkable[codes])
        # an initial and a given name with the same letter before the same family name
        letter = np.array([ord(f[0]) if a and c else 0 for f, a, c in zip(low, alpha, capital, strict=True)], np.int64)
        family = np.append(np.where(alpha & capital & (size > 1), folded, -1), -1)
        dot = np.append(np.array([k == "." for k in kinds]), False)
        one = np.append(alpha & capital & (size == 1), False)[codes]
        after, after2 = moved(codes, -1, none), moved(codes, -2, none)
        to = np.where(one & dot[after], family[after2], np.where(~one, family[after], -1))
        first = np.flatnonzero((letter[codes] > 0) & (to >= 0))
        return [(same, mine[same]), (any_case, mine[any_case]), (first, to[first] * 0x110000 + letter[codes][first]), (digits, mine[digits])]

    def skip_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, sort): places of linked words, a before b, and the sort of the link: 0 a capitalised word repeated, 1 a word repeated in another case (as in an address for mail),
        2 an initial and a given name before the same family name, 3 digits repeated. One link per repeat, however often a word comes."""
        seen, out = np.zeros(0, np.int64), []
        for sort, (places, keys) in enumerate(self._link_keys):
            order = np.lexsort((places, keys, self.owner[places])) if len(places) else np.zeros(0, np.int64)
            p, k = places[order], keys[order]
            same = (k[1:] == k[:-1]) & (self.owner[p[1:]] == self.owner[p[:-1]]) & (p[1:] - p[:-1] > 1)
            a, b = p[:-1][same], p[1:][same]
            name = a * (len(self.tokens) + 1) + b
            new = ~np.isin(name, seen)
            seen = np.concatenate((seen, name[new]))
            out.append((a[new], b[new], np.full(int(new.sum()), sort)))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @property
    def features(self) -> np.ndarray:
        """The feature buckets of every word."""
        columns = [table[code] for code, tables in self.by_kind for table in tables] + self.by_word
        return np.stack(columns, 1) if columns else np.zeros((0, 1), np.int64)

    def labels(self, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
        out = np.zeros(len(self.tokens), np.int64)
        at = 0
        for n, mine in zip(self.rows, spans, strict=True):
            s = self.starts[at : at + n]
            for a, b, kind in mine:
                x, y = np.searchsorted(s, a), np.searchsorted(s, b)
                if y > x:
                    out[at + x : at + y] = 2 + 2 * kind
                    out[at + x] = 1 + 2 * kind
            at += n
        return out


# ---- the field ----

_ALLOWED = np.ones((N_LABELS, N_LABELS), bool)
for _k in range(len(TYPES)):
    _ALLOWED[:, 2 + 2 * _k] = False
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
_START = np.array([i == 0 or i % 2 == 1 for i in range(N_LABELS)])
#: What two linked labels say together: 0 both outside, 1 mentions of one type, 2 mentions of two types, 3 one of them outside.
_TOGETHER = np.array([[0 if a == b == 0 else 3 if a == 0 or b == 0 else 1 if (a - 1) // 2 == (b - 1) // 2 else 2 for b in range(N_LABELS)] for a in range(N_LABELS)])
N_SORTS, N_TOGETHER = 4, 4


def _padded(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, mask, core, first) of chains of like length: places is words x chains into the flat arrays, core the words whose result counts, first the chains that begin a text."""
    starts = np.concatenate(([0], np.cumsum(rows)[:-1])) if len(rows) else np.zeros(0, np.int64)
    short = (rows > 0) & (rows <= PIECE + 2 * MARGIN)
    pieces = [np.stack([starts[short], rows[short], np.zeros(short.sum(), np.int64), rows[short], np.ones(short.sum(), np.int64)], 1)]
    for i in np.flatnonzero(rows > PIECE + 2 * MARGIN):
        low = np.arange(0, rows[i], PIECE)
        begin, end = np.maximum(low - MARGIN, 0), np.minimum(low + PIECE + MARGIN, rows[i])
        pieces.append(np.stack([starts[i] + begin, end - begin, low - begin, np.minimum(low + PIECE, rows[i]) - begin, (low == 0).astype(np.int64)], 1))
    every = np.concatenate(pieces)
    every = every[np.argsort(every[:, 1], kind="stable")]
    at = 0
    while at < len(every):
        longest = int(every[min(at + 511, len(every) - 1), 1])
        take = every[at : at + max(1, min(512, 400_000 // max(1, longest)))]
        steps = np.arange(int(take[-1, 1]))[:, None]
        mask = steps < take[:, 1][None]
        core = (steps >= take[:, 2][None]) & (steps < take[:, 3][None])
        yield np.where(mask, take[:, 0][None] + steps, 0), mask, core, take[:, 4] == 1
        at += len(take)


class Field:
    """Weights of the field: by feature and label, by neighbouring labels, and by what linked labels say together for each sort of link."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, ties: np.ndarray, given, family):
        self.weights, self.moves, self.ties, self.given, self.family = weights, moves, ties, given, family
        self.step = np.where(_ALLOWED, np.exp(moves), 0)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the fitted field as one file, for use in later runs."""
        held = io.BytesIO()
        np.savez_compressed(held, weights=self.weights, moves=self.moves, ties=self.ties, given=self.given.bits, family=self.family.bits)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(held.getvalue()))
        out.close()

    @staticmethod
    def load(spark: SparkSession, path: str) -> Field:
        held = np.load(io.BytesIO(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])))
        names = []
        for which in ("given", "family"):
            names.append(NameFilter())
            names[-1].bits = held[which]
        return Field(held["weights"], held["moves"], held["ties"], *names)

    def scores(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.tokens), N_LABELS), np.float32)
        for code, tables in words.by_kind:
            out += sum(self.weights[t] for t in tables)[code]
        looked_up = np.empty_like(out)
        for column in words.by_word:
            out += np.take(self.weights, column, axis=0, out=looked_up, mode="clip")
        return out

    def _chain(self, local: np.ndarray, places: np.ndarray, mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward messages over many chains at once; local is exp(score) by word, and padding keeps the message."""
        steps, n = places.shape
        p, move, back = local[places], self.step.astype(local.dtype), np.ascontiguousarray(self.step.T).astype(local.dtype)
        forward, backward = np.empty((steps, n, N_LABELS), local.dtype), np.ones((steps, n, N_LABELS), local.dtype)
        whole = int(mask.all(1).sum())  # the steps that every chain has
        f = p[0] * np.where(first[:, None], _START[None], True)
        f /= f.sum(1, keepdims=True)
        forward[0] = f
        for t in range(1, steps):
            g = (f @ move) * p[t]
            g /= g.sum(1, keepdims=True)
            f = g if t < whole else np.where(mask[t][:, None], g, f)
            forward[t] = f
        b = backward[-1]
        for t in range(steps - 2, -1, -1):
            g = (b * p[t + 1]) @ back
            g /= g.sum(1, keepdims=True)
            b = g if t + 1 < whole else np.where(mask[t + 1][:, None], g, 1)
            backward[t] = b
        return p, forward, backward

    def beliefs(self, local: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty_like(local)
        for places, mask, core, first in _padded(rows):
            _, f, b = self._chain(local, places, mask, first)
            m = f * b
            m /= m.sum(2, keepdims=True)
            out[places[core]] = m[core]
        return out

    def passed(self, base: np.ndarray, rows: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loopy message passing: the chains are solved, linked words send each other what they believe without the other's word, and again. Gives the local factors with the last messages,
        those messages by end of a link, and the beliefs at the ends without the message of the link's other end."""
        a, b, sort = links
        psi = np.exp(ties)[sort[:, None, None], _TOGETHER[None]].astype(base.dtype)  # the same seen from either end
        ends, others = np.concatenate((a, b)), np.concatenate((b, a))
        psi = np.concatenate((psi, psi))
        sent = np.ones((len(ends), N_LABELS), base.dtype)  # sent[i]: from ends[i] to others[i]
        twin = np.concatenate((np.arange(len(a), 2 * len(a)), np.arange(len(a))))
        owner = np.repeat(np.arange(len(rows)), rows)
        linked = np.zeros(len(rows), bool)
        linked[owner[ends]] = True
        pick = linked[owner]
        index = np.cumsum(pick) - 1
        mine, cavity = base[pick], sent
        within = mine
        order = np.argsort(index[others], kind="stable")
        told, edges = np.unique(index[others][order], return_index=True)
        for _ in range(rounds):
            belief = self.beliefs(within, rows[linked])
            cavity = belief[index[ends]] / sent[twin]
            cavity /= cavity.sum(1, keepdims=True)
            message = np.einsum("il,ilm->im", cavity, psi)
            message /= message.max(1, keepdims=True)
            sent = np.sqrt(sent * message)  # half a step, so that loops settle
            gathered = np.add.reduceat(np.log(sent[order]), edges, axis=0)
            changed = mine[told] * np.exp(gathered - gathered.max(1, keepdims=True)).astype(base.dtype)
            within = mine.copy()
            within[told] = np.maximum(changed / changed.max(1, keepdims=True), np.float32(1e-26))
        local = base.copy()
        local[pick] = within
        return local, sent, cavity

    def decode(self, words: Words, rounds: int = 2, coupled: bool = True) -> np.ndarray:
        """The labels of all words: the best path of each chain under the last messages of its links, after as many rounds as in fitting; coupled False leaves the links out."""
        score = self.scores(words)
        if not len(score):
            return np.zeros(0, np.int64)
        base = np.exp(np.maximum(score - score.max(1, keepdims=True), -60.0))
        links = words.skip_links()
        if coupled and len(links[0]):
            base = self.passed(base, words.rows, links, rounds, self.ties)[0]
        return self._best(np.log(base), words.rows)

    def _best(self, score: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(score), np.int64)
        moves = np.where(_ALLOWED, self.moves, -1e9).astype(np.float32)
        # a mention is only continued by its own type, so two ways lead to such a label; all others come from anywhere
        opens, goes_on, begins = np.flatnonzero(_START), np.flatnonzero(~_START), np.flatnonzero(~_START) - 1
        into, from_begin, from_inside = np.ascontiguousarray(moves[:, opens].T), moves[begins, goes_on], moves[goes_on, goes_on]
        for places, mask, core, first in _padded(rows):
            steps, n = places.shape
            whole = int(mask.all(1).sum())
            best = score[places[0]] + np.where(first[:, None] & ~_START[None], np.float32(-1e9), np.float32(0))
            back = np.empty((steps, n, N_LABELS), np.int8)
            new = np.empty((n, N_LABELS), np.float32)
            for t in range(1, steps):
                paths = best[:, None, :] + into[None]
                back[t][:, opens] = paths.argmax(2)
                new[:, opens] = paths.max(2)
                a, b = best[:, begins] + from_begin, best[:, goes_on] + from_inside
                back[t][:, goes_on] = np.where(a >= b, begins, goes_on)
                new[:, goes_on] = np.maximum(a, b)
                got = new + score[places[t]]
                best = got if t < whole else np.where(mask[t][:, None], got, best)
            last = best.argmax(1)
            for t in range(steps - 1, -1, -1):
                live = core[t]
                out[places[t][live]] = last[live]
                if t:
                    last = np.where(mask[t], back[t][np.arange(n), last], last)
        return out


def fit(texts: list[str], given, family, passes: int = 6, batch: int = 32, rate: float = 0.4, decay: float = 1e-6, rounds: int = 2, seed: int = 3, spans: list[list[tuple[int, int, int]]] | None = None) -> Field:
    """Fits the field to texts with labels (start, end, type), by default those of sample_labels, by adaptive gradient steps on the likelihood.

    Four fifths of the texts fit the weights of features and neighbours, then all weights, those of links too, are fitted on every text, with the expectations of a text from loopy message passing over
    its whole graph. The steps for the links are taken on the fifth that the features have not seen, as what is learnt by heart leaves nothing to a link. A third of the
    steps see no list of names, so that the words around a name and its form are learnt too.

    A third of the texts at most are without any mention, as they teach little. No text with a mention gives a field that finds nothing.
    """
    rng = np.random.default_rng(seed)
    spans = [sample_labels(t, given, family) for t in texts] if spans is None else spans
    order = rng.permutation(len(texts))
    some = [i for i in order if spans[i]]
    chosen = some + [i for i in order if not spans[i]][: max(20, len(some) // 2)]
    chosen = [chosen[i] for i in rng.permutation(len(chosen))]
    field = Field(np.zeros((BUCKETS, N_LABELS), np.float32), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_SORTS, N_TOGETHER)), given, family)
    if not some:
        field.weights[:, 0] = 1.0
        return field

    def packed(mine: list[int], blind) -> list[tuple]:
        mine = sorted(mine, key=lambda i: len(texts[i]))  # texts of like length together
        out = []
        for k, at in enumerate(range(0, len(mine), batch)):
            part = mine[at : at + batch]
            words = Words([texts[i] for i in part], given, family, blind=blind(k))
            if len(words.tokens):
                out.append((words, words.features, words.labels([spans[i] for i in part]), words.skip_links()))
        return out

    fitted = _Steps(field, rate, decay, rounds)
    held, rest = chosen[: len(chosen) // 5], chosen[len(chosen) // 5 :]
    packs = packed(rest, lambda k: k % 3 == 2)
    for _ in range(passes - 1):
        for k in rng.permutation(len(packs)):
            fitted.step(*packs[k], ties=False)
    # the links, on texts that are new to the features, with and without the lists of names
    fresh = packed(held, lambda k: False) + packed(held, lambda k: True)
    for _ in range(3):
        for k in rng.permutation(len(fresh)):
            fitted.step(*fresh[k], ties=True, weights=False)
    packs += packed(held, lambda k: k % 3 == 2)
    for k in rng.permutation(len(packs)):
        fitted.step(*packs[k], ties=True, move_ties=False)
    return field


class _Steps:
    """Adaptive gradient steps on the likelihood of a field."""

    def __init__(self, field: Field, rate: float, decay: float, rounds: int):
        self.field, self.rate, self.decay, self.rounds = field, rate, decay, rounds
        self.grown, self.grown_moves, self.grown_ties = np.full((BUCKETS, N_LABELS), 1e-6, np.float32), np.full((N_LABELS, N_LABELS), 1e-6), np.full((N_SORTS, N_TOGETHER), 1e-3)

    def step(self, words: Words, features: np.ndarray, gold: np.ndarray, links: tuple, ties: bool, weights: bool = True, move_ties: bool = True) -> None:
        field = self.field
        score = field.scores(words)
        local = np.exp(np.maximum(score - score.max(1, keepdims=True), -60.0))
        if ties and len(links[0]):
            local, _, cavity = field.passed(local, words.rows, links, self.rounds, field.ties)
            if move_ties:
                self._of_ties(gold, links, cavity)
        if weights:
            self._of_weights(words, features, gold, local)

    def _of_ties(self, gold: np.ndarray, links: tuple, cavity: np.ndarray) -> None:
        field, (a, b, sort) = self.field, links
        both = cavity[: len(a), :, None] * np.exp(field.ties)[sort[:, None, None], _TOGETHER[None]] * cavity[len(a) :, None, :]
        both /= both.sum((1, 2), keepdims=True)
        gap = np.zeros((N_SORTS, N_TOGETHER))
        np.add.at(gap, (sort, _TOGETHER[gold[a], gold[b]]), 1)
        for c in range(N_TOGETHER):
            np.add.at(gap, (sort, c), -both[:, _TOGETHER == c].sum(1))
        self.grown_ties += gap**2
        field.ties += self.rate * gap / np.sqrt(self.grown_ties)

    def _of_weights(self, words: Words, features: np.ndarray, gold: np.ndarray, local: np.ndarray) -> None:
        field = self.field
        gap = np.zeros((len(gold), N_LABELS), np.float32)
        gap_moves = np.zeros((N_LABELS, N_LABELS))
        for places, mask, core, first in _padded(words.rows):
            p, f, b = field._chain(local, places, mask, first)
            m = f * b
            m /= m.sum(2, keepdims=True)
            gap[places[core]] = -m[core]
            g = gold[places]
            live = core[1:] & mask[1:]
            # neighbours that are surely outside move nothing
            live &= ~((m[:-1, :, 0] > 0.9999) & (m[1:, :, 0] > 0.9999) & (g[:-1] == 0) & (g[1:] == 0))
            two = f[:-1][live][:, :, None] * field.step[None].astype(np.float32) * (p[1:][live] * b[1:][live])[:, None, :]
            two /= two.sum((1, 2), keepdims=True)
            gap_moves -= two.sum(0)
            np.add.at(gap_moves, (g[:-1][live], g[1:][live]), 1)
        gap[np.arange(len(gold)), gold] += 1
        open_ = np.flatnonzero(np.abs(gap).max(1) > 1e-4)
        touched, spot = np.unique(features[open_].ravel(), return_inverse=True)
        step = np.zeros((len(touched), N_LABELS), np.float32)
        for c in range(N_LABELS):
            step[:, c] = np.bincount(spot, np.repeat(gap[open_, c], features.shape[1]), len(touched))
        step -= self.decay * len(gold) * field.weights[touched]
        self.grown[touched] += step * step
        field.weights[touched] += self.rate * step / np.sqrt(self.grown[touched])
        self.grown_moves += gap_moves**2
        field.moves += self.rate * gap_moves / np.sqrt(self.grown_moves)
        field.step = np.where(_ALLOWED, np.exp(field.moves), 0)


def _within(kind: int, surface: str) -> tuple[int, int] | None:
    """The part of a labelled stretch that the definition of its type admits, or None: a phone from its first plus sign, bracket or digit to its last digit, a number and a mail address from letter or
    digit to letter or digit, a name with a capital in at least two words, an address with a number."""
    if kind == 2:
        m = re.search(r"[+(\d].*\d", surface, re.S)
        return m.span() if m and sum(c.isdigit() for c in m[0]) >= 7 else None
    m = re.search(r"\w.*\w", surface, re.S)
    if not m:
        return None
    text = m[0]
    if kind == 0:
        return m.span() if sum(w[0].isupper() for w in re.findall(r"[^\W\d_]+", text)) >= 2 else None
    if kind == 1:
        low = text.lower()
        return m.span() if "@" in text or re.search(r"\bat\b", low) and re.search(r"\bdot\b|\.", low) else None
    digits = sum(c.isdigit() for c in text)
    return m.span() if digits >= (5 if kind == 3 else 1) else None


def mentions(words: Words, labels: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, start, end, type) of the labelled mentions in order, each within the definition of its type."""
    begins = np.flatnonzero(labels % 2 == 1)
    for b in begins:
        e, inside = b + 1, labels[b] + 1
        while e < len(labels) and labels[e] == inside and words.owner[e] == words.owner[b]:
            e += 1
        owner, start, end, kind = int(words.owner[b]), int(words.starts[b]), int(words.ends[e - 1]), int(labels[b] // 2)
        part = _within(kind, words.texts[owner][start:end])
        if part:
            yield owner, start + part[0], start + part[1], kind


# ---- over tables ----


def known_names(authors: DataFrame, column: str = "authors") -> tuple[NameFilter, NameFilter]:
    """Given and family names (first and last words) of all author entries of an array column, as two bit fields of a fixed size, which are filled where the rows are."""
    each = authors.select(F.explode(column).alias("a")).select(F.split(F.lower(F.trim("a")), r"\s+").alias("w")).filter(F.size("w") > 1)
    words = each.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("w")[0].alias("n")), F.struct(F.lit(1).alias("kind"), F.element_at("w", -1).alias("n")))).alias("s")).select("s.*").filter(F.length("n") > 1).distinct()
    digest = F.md5("n")
    places = words.select("kind", F.explode(F.array(*[F.conv(F.substring(digest, at, 6), 16, 10).cast("int") for at in (1, 7)])).alias("p"))
    cells = places.groupBy("kind", F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("bits"))
    rows = cells.collect()  # at most 2 x BITS / 64 cells, however many names there are
    return tuple(NameFilter({r.cell: r.bits for r in rows if r.kind == k}) for k in (0, 1))


def fit_on(documents: DataFrame, given: NameFilter, family: NameFilter, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted on about `rows` texts (never more) of at most `chars` characters. The hash of an id decides whether its text is drawn, so each task sends only what is drawn."""
    fits = documents.filter(F.length(text_col).between(1, chars))
    share = min(1.0, 0.9 * rows / max(1, fits.count()))
    drawn = fits.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 40)) < int(share * (1 << 40)))
    return fit(sorted(r.t for r in drawn.select(F.col(text_col).alias("t")).limit(rows).collect()), given, family)


def _found(field, id_col: str, text_col: str, redact: bool, chunk_chars: int = 1_500_000):
    def label(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        model: Field = field.value
        words = Words(texts, model.given, model.family)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, a, b, kind in mentions(words, model.decode(words)):
            out[i].append((a, b, kind))
        return out

    def rows(ids: list, texts: list) -> pd.DataFrame:
        if redact:
            text, counts = [], []
            for t, spans in zip(texts, label([x or "" for x in texts]), strict=True):
                if t is not None:
                    done, at = [], 0
                    for a, b, kind in spans:
                        done += [t[at:a], f"[{TYPES[kind].upper()}]"]
                        at = b
                    t = "".join([*done, t[at:]])
                text.append(t)
                counts.append(len(spans))
            return pd.DataFrame({id_col: ids, "clean_text": text, "n_replaced": counts})
        got = [(i, TYPES[kind], t[a:b]) for i, t, spans in zip(ids, texts, label([x or "" for x in texts]), strict=True) for a, b, kind in spans]
        return pd.DataFrame(got, columns=[id_col, "pii_type", "surface"]).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch[id_col], batch[text_col], strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size > chunk_chars:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield rows(ids, texts)

    return run


def find_pii(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pii_type, surface): the distinct mentions of every text, as they stand. Null and empty texts have none; a repeated id has those of all its rows; other columns are ignored."""
    held = documents.sparkSession.sparkContext.broadcast(field)
    kind = dict(documents.dtypes)[id_col]
    return documents.select(id_col, text_col).mapInPandas(_found(held, id_col, text_col, False), f"`{id_col}` {kind}, pii_type string, surface string").distinct()


def redact(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, clean_text, n_replaced): every row's text with [NAME], [EMAIL], [PHONE], [ID_NUMBER] or [ADDRESS] in the place of each mention and all else unchanged; null stays null."""
    held = documents.sparkSession.sparkContext.broadcast(field)
    kind = dict(documents.dtypes)[id_col]
    return documents.select(id_col, text_col).mapInPandas(_found(held, id_col, text_col, True), f"`{id_col}` {kind}, clean_text string, n_replaced int")
