"""Exact token counts at every prefix of a text, by dynamic programming over a byte-pair vocabulary.

Two facts make the table exact.

*Inside a word.*  A sequence of tokens is what byte-pair merging makes of its bytes if and only if every
two neighbours stay apart when merged on their own.  So each prefix of a word has one last token: the
longest token that ends there and stays apart from the last token of what is left before it, and
``count[i] = count[i - len(last[i])] + 1``.

*Between words.*  The vocabulary's splitting rule cuts a text from left to right into words that never
merge, so ``count(prefix) = count(words before) + count(prefix of the last word)``.

Truncation ("the longest prefix of at most n tokens") and budget questions are then look-ups in a stored
table; the text is not encoded again.  Words and the pieces between single spaces recur, so both are
remembered, within a bound on memory (never on the work)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Remembered pieces and words per Python worker; beyond that the memory starts anew.
REMEMBERED = 600_000
#: Longer pieces are not remembered with their prefix tables.
REMEMBERED_CHARS = 64
#: Bytes of a word of letters, with the space before it, that is worked out together with others, and how many at a time.
PLAIN_BYTES, PLAIN_WORDS = 32, 20_000
#: Fixed value: an odd multiplier that scatters all bits.
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes up to which the prefixes of a word are remembered.
LONG_WORD = 200
#: Rows whose prefix tables are handed on at once.
STORED_ROWS = 512


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies print each byte as one visible character: itself, or the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixTable:
    """Token counts of every prefix of a word, of a piece and of a text, for one vocabulary file."""

    #: Fixed value: the splitting rule that byte-level vocabularies of this family are made with.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda shown: bytes(alphabet[c] for c in shown)
        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        # Ranks order tokens by the time they are formed: single bytes first, then one per merge.
        self.rank = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(-1, -1)] * 256
        self.merged: dict[int, int] = {}
        for merge in model["merges"]:
            left, right = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, new = self.rank[left], self.rank[right], len(self.parts)
            self.rank.setdefault(left + right, new)
            self.parts.append((a, b))
            self.merged[a << 20 | b] = new
        self.id_of_rank = [0] * len(self.parts)
        for token, r in self.rank.items():
            self.id_of_rank[r] = self.ids[token]
        self.longest = max(map(len, self.rank))
        # Lengths of the tokens that end in three given bytes, longest first.
        lengths: dict[bytes, set[int]] = {}
        for token in self.rank:
            if len(token) >= 3:
                lengths.setdefault(token[-3:], {1, 2}).add(len(token))
        self.lengths = {end: tuple(sorted(x, reverse=True)) for end, x in lengths.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(self.SPLIT).findall
        self._apart: dict[int, bool] = {}
        self._prefixes: dict[bytes, int] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._counts: dict[str, int] = {}
        self._older: dict[str, int] = {}
        self._steps: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._prepare_plain()
        self.spaces_meet = regex.compile(r"\s\s").search

    def apart(self, a: int, b: int) -> bool:
        """Do tokens a and b stay two tokens when their bytes are merged together?

        Undo the merges of both in reverse order of forming.  If the pair that meets at the border could
        have merged before the merge just undone, merging would have crossed the border."""
        bound = len(self.parts)
        while True:
            if self.merged.get(a << 20 | b, bound) < bound:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                bound, a = a, self.parts[a][1]
            else:  # of equal merges the left one comes first, so the border pair wins a tie with the right token
                bound, b = b + 1, self.parts[b][0]

    def _stay_apart(self, key: int) -> bool:
        ok = self._apart.get(key)
        if ok is None:
            if len(self._apart) >= REMEMBERED:
                self._apart.clear()
            ok = self._apart[key] = self.apart(key >> 20, key & 0xFFFFF)
        return ok

    def _last(self, prefix: bytes) -> int:
        """Token count and last token of one prefix of a word as count << 20 | token, remembered by the prefix.

        Words share their beginnings, so most of the recursion ends in what is known."""
        known = self._prefixes
        found = known.get(prefix)
        if found is not None:
            return found
        rank, apart, size = self.rank, self._apart, len(prefix)
        for n in self.lengths.get(prefix[-3:], (2, 1)):
            if n > size:
                continue
            token = rank.get(prefix[-n:])
            if token is None:
                continue
            if n == size:
                found = 1 << 20 | token
                break
            head = prefix[:-n]
            before = known.get(head) or self._last(head)
            key = (before & 0xFFFFF) << 20 | token
            ok = apart.get(key)
            if self._stay_apart(key) if ok is None else ok:
                found = ((before >> 20) + 1) << 20 | token
                break
        if len(known) >= REMEMBERED:
            known.clear()
        known[prefix] = found
        return found

    def _last_tokens(self, data: bytes) -> list[int]:
        """Last token of every prefix, front to back: no recursion, so words may be of any length."""
        rank, lengths, apart = self.rank.get, self.lengths.get, self._apart.get
        last = [-1] * (len(data) + 1)
        for i in range(1, len(data) + 1):
            for n in lengths(data[max(0, i - 3) : i], (2, 1)):
                if n > i:
                    continue
                token = rank(data[i - n : i])
                if token is None:
                    continue
                if n == i:
                    last[i] = token
                    break
                key = last[i - n] << 20 | token
                ok = apart(key)
                if self._stay_apart(key) if ok is None else ok:
                    last[i] = token
                    break
        return last

    def word_ids(self, word: str) -> list[int]:
        data, size, tail = word.encode("utf-8", "replace"), self._size, []
        last = self._last_tokens(data) if len(data) > LONG_WORD else None
        i = len(data)
        while i:
            token = last[i] if last else self._last(data[:i]) & 0xFFFFF
            tail.append(self.id_of_rank[token])
            i -= size[token]
        return tail[::-1]

    def word_count(self, word: str) -> int:
        data = word.encode("utf-8", "replace")
        return self._last(data) >> 20 if 0 < len(data) <= LONG_WORD else len(self.word_ids(word))

    @property
    def _size(self) -> list[int]:
        if not hasattr(self, "_sizes"):
            self._sizes = [0] * len(self.parts)
            for token, r in self.rank.items():
                self._sizes[r] = len(token)
        return self._sizes

    def word_counts(self, word: str) -> list[int]:
        """Exact token count of each prefix of one word, by code points: element k is for word[:k]."""
        if word[:1] == "'" and len(word) > 1 and len(self.find(word)) == 1 and word[1].isalpha():
            # A contraction: its shorter prefixes split into the apostrophe and the letters after it.
            return [0, *(sum(map(self.word_count, self.find(word[:k]))) for k in range(1, len(word))), self.word_count(word)]
        data = word.encode("utf-8", "replace")
        if len(data) == len(word) <= LONG_WORD:  # one byte a character, and a prefix that other words share is known
            known = self._prefixes.get
            return [0, *[(known(data[:i]) or self._last(data[:i])) >> 20 for i in range(1, len(data) + 1)]]
        counts, size = [0] * (len(data) + 1), self._size
        for i, token in enumerate(self._last_tokens(data)):
            if i:
                counts[i] = counts[i - size[token]] + 1
        if len(data) == len(word):
            return counts
        ends = [0]
        for c in word:
            ends.append(ends[-1] + len(c.encode("utf-8", "replace")))
        return [counts[e] for e in ends]

    def _pieces_of(self, text: str) -> list[str]:
        """Cut at single spaces, where a word always begins; next to other white space, the rule itself cuts."""
        if "  " in text:
            return self.find(text)
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)] if head else [" " + x for x in rest]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        found = self._pieces.get(piece)
        if found is None:
            found = tuple(i for w in self.find(piece) for i in self.word_ids(w))
            if len(self._pieces) >= REMEMBERED:
                self._pieces.clear()
            self._pieces[piece] = found
        return found

    def piece_count(self, piece: str) -> int:
        found = self._older.get(piece)
        if found is None:
            found = self.word_count(piece) if piece.isalpha() or piece[0] == " " and piece[1:].isalpha() else sum(map(self.word_count, self.find(piece)))
        if len(self._counts) >= REMEMBERED:  # keep what was met lately
            self._older = dict(self._counts)
            self._counts.clear()
        self._counts[piece] = found
        return found

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text around special strings, and these (True)."""
        if self.cut_special is None or not any(s in text for s in self.special):
            yield text, False
            return
        for k, part in enumerate(self.cut_special.split(text)):
            if part:
                yield part, bool(k % 2)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text; special strings count as their token."""
        out: list[int] = []
        known = self._pieces
        for part, special in self._parts(text):
            if special:
                out.append(self.special[part])
                continue
            for piece in self._pieces_of(part):
                ids = known.get(piece)
                out.extend(self.piece_ids(piece) if ids is None else ids)
        return np.array(out, dtype="<u4")

    def count(self, text: str) -> int:
        """Token count of a whole text: the last entry of its prefix table."""
        total, known = 0, self._counts
        for part, special in self._parts(text):
            if special:
                total += 1
                continue
            for piece in self._pieces_of(part):
                n = known.get(piece)
                total += self.piece_count(piece) if n is None else n
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of text[:k] for every k from 0 to len(text)."""
        counts = np.zeros(len(text) + 1, dtype=np.int32)
        base, start, open_text = 0, 0, ""
        for part, special in self._parts(text):
            if special:  # cut inside, a special string is plain text that joins what stands before it
                for k in range(1, len(part)):
                    counts[start + k] = base - self.count(open_text) + self.count(open_text + part[:k])
                base, open_text = base + 1, ""
                start += len(part)
                counts[start] = base
                continue
            open_text, before = part, ""
            for word in self.find(part):
                inner = self.word_counts(word)
                counts[start + 1 : start + len(word) + 1] = np.add(inner[1:], base)
                if before and before.isspace() and word[0].isspace():  # cut here, both runs of white space are one
                    counts[start + 1] = base - self.word_count(before) + self.word_count(before + word[0])
                base, start, before = base + inner[-1], start + len(word), word
        return counts

    def _word_steps(self, words: Iterable[str]) -> None:
        """Work out the tables of words, as stored, and remember them: plain ones all at once, others one by one."""
        plain = []
        for word in words:
            if len(word) <= PLAIN_BYTES and word.lstrip(" ").isalpha() and (word.isascii() or len(word.encode("utf-8", "replace")) <= PLAIN_BYTES):
                plain.append(word)
            else:
                self._words[word] = steps(np.array(self.word_counts(word)))
        for at in range(0, len(plain), PLAIN_WORDS):
            some = plain[at : at + PLAIN_WORDS]
            self._words.update(zip(some, self.plain_steps([w.encode("utf-8", "replace") for w in some])))

    def plain_steps(self, words: list[bytes]) -> list[bytes]:
        """The programme over all positions of many words at once: at position i every word finds its last token.

        From the longest down, the bytes before i are looked up by their hash, and a token counts where it stays
        apart from the last token before it; the table of those pairs grows by what is met."""
        sizes = np.array([len(w) for w in words])
        longest = int(sizes.max(initial=0))
        data = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), dtype=np.uint8).reshape(len(words), longest).T.astype(np.uint64)
        hashes, last, counts = (np.zeros((longest + 1, len(words)), dtype=k) for k in (np.uint64, np.int64, np.int16))
        for i in range(1, longest + 1):
            hashes[i] = hashes[i - 1] * HASH_BASE + data[i - 1] + np.uint64(1)
            open_ = np.flatnonzero(sizes >= i)
            for n in range(min(i, self.plain_longest), 0, -1):
                if not len(open_):
                    break
                wanted = hashes[i, open_] - hashes[i - n, open_] * self.powers[n]
                maybe = np.flatnonzero(self.seen[wanted >> np.uint64(44)])
                place = np.searchsorted(self.plain_hashes, wanted[maybe])
                place[place == len(self.plain_hashes)] = 0
                hit = (self.plain_hashes[place] == wanted[maybe]) & (self.plain_sizes[place] == n)
                maybe, token = maybe[hit], self.plain_ranks[place[hit]]
                if n < i:
                    ok = self._all_apart(last[i - n, open_[maybe]] << 20 | token)
                    maybe, token = maybe[ok], token[ok]
                chosen = open_[maybe]
                last[i, chosen], counts[i, chosen] = token, counts[i - n, chosen] + 1
                open_ = np.delete(open_, maybe)
        # A code point ends where the next byte begins another; the counts there, and the zero before each word.
        ends = np.ones((len(words), longest + 1), dtype=bool)
        ends[:, 1:-1] = (data[1:].T & np.uint64(0xC0)) != 0x80
        ends &= np.arange(longest + 1) <= sizes[:, None]
        stored = np.diff(counts.T[ends], append=0).astype("<i2").tobytes()
        until = np.cumsum(2 * ends.sum(axis=1)).tolist()
        return [stored[start : end - 2] for start, end in zip([0, *until], until)]

    def _all_apart(self, keys: np.ndarray) -> np.ndarray:
        """`apart` for many pairs; new ones are worked out once each."""
        place = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        missing = self._pairs[place] != keys
        if missing.any():
            new = np.unique(keys[missing])
            if len(self._pairs) > REMEMBERED:
                self._pairs, self._pairs_apart = self._pairs[:1], self._pairs_apart[:1]
            pairs = np.concatenate([self._pairs, new])
            answers = np.concatenate([self._pairs_apart, np.array([self.apart(k >> 20, k & 0xFFFFF) for k in new.tolist()], dtype=bool)])
            order = np.argsort(pairs, kind="stable")
            self._pairs, self._pairs_apart = pairs[order], answers[order]
            return self._all_apart(keys)
        return self._pairs_apart[place]

    def _prepare_plain(self) -> None:
        """Tokens of letters, or bytes of such, and a leading space, by the hash of their bytes."""
        inner = lambda t: all(x >= 0x80 or chr(x).isalpha() for x in t)
        tokens = [(t, r) for t, r in self.rank.items() if len(t) <= PLAIN_BYTES and inner(t.removeprefix(b" "))]
        self.plain_longest = max(len(t) for t, _ in tokens)
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(PLAIN_BYTES, HASH_BASE, dtype=np.uint64)), dtype=np.uint64)
        hashed = []
        for token, _ in tokens:
            h = 0
            for byte in token:
                h = (h * int(HASH_BASE) + byte + 1) % (1 << 64)
            hashed.append(h)
        order = np.argsort(np.array(hashed, dtype=np.uint64), kind="stable")
        self.plain_hashes = np.array(hashed, dtype=np.uint64)[order]
        self.plain_ranks = np.array([r for _, r in tokens], dtype=np.int64)[order]
        self.plain_sizes = np.array([len(t) for t, _ in tokens])[order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.plain_hashes >> np.uint64(44)] = True
        self._pairs, self._pairs_apart = np.array([-1], dtype=np.int64), np.zeros(1, dtype=bool)

    def prefix_steps(self, texts: list[str]) -> list[bytes]:
        """`steps(prefix_counts(text))` of each text, joined from words where no cut can change what stands before it.

        Only next to other white space, or inside a special string, does a cut change the tokens before it; texts
        with such places are worked out whole.  The words that no piece before had are worked out together."""
        if len(self._steps) >= REMEMBERED or len(self._words) >= REMEMBERED:
            self._steps, self._words = {}, {}
        out, pieces = [], {}
        for k, text in enumerate(texts):
            whole = self.spaces_meet(text) or self.cut_special is not None and any(s in text for s in self.special)
            out.append(steps(self.prefix_counts(text)) if whole else None)
            if not whole:
                pieces[k] = self._pieces_of(text)
        known, words = self._steps, self._words
        new = {p for some in pieces.values() for p in some if p not in known}
        parts = {p: (p,) if p.isalpha() or p[1:].isalpha() and p[0] == " " else tuple(self.find(p)) for p in new}
        self._word_steps({w for some in parts.values() for w in some if w not in words})
        for piece, some in parts.items():
            known[piece] = b"".join([words[w] for w in some])
        for k, some in pieces.items():
            out[k] = b"".join([known[p] for p in some])
        for piece in parts:  # long ones do not recur
            if len(piece) > REMEMBERED_CHARS:
                del known[piece]
        for word in {w for some in parts.values() for w in some if len(w) > REMEMBERED_CHARS}:
            del words[word]
        return out


@lru_cache(maxsize=4)
def prefix_table(path: str) -> PrefixTable:
    """One table per vocabulary file and Python worker."""
    return PrefixTable(path)


def steps(counts: np.ndarray) -> bytes:
    """A prefix table as stored: one signed 16-bit difference per code point."""
    return np.diff(counts).astype("<i2").tobytes()


def counts_from(stored: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(stored, dtype="<i2"))])


def longest_prefix(stored: bytes, budget: int) -> int:
    """Most code points of the text that take at most `budget` tokens, read from the stored table."""
    return int(np.flatnonzero(counts_from(stored) <= budget)[-1])


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = 512, vocabulary: str | None = None, store: bool = False) -> DataFrame:
    """`key`, n_bytes, n_tokens and over_limit of every whole text; with `store` also `steps`, its prefix table.

    Null and empty texts have 0 bytes and 0 tokens.  Rows stay one to one: repeated rows, null keys and
    ties give a row each; other columns of `docs` are not read.  An empty table gives an empty result."""
    path = vocabulary or default_vocabulary()
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for whole in batches:
            for at in range(0, whole.num_rows, STORED_ROWS):
                batch = whole.slice(at, STORED_ROWS)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                stored = table.prefix_steps(texts) if store else None
                tokens = [int(np.frombuffer(c, dtype="<i2").sum(dtype=np.int64)) for c in stored] if store else [table.count(x) for x in texts]
                columns = [batch.column(0), pa.array([len(x.encode("utf-8", "replace")) for x in texts], pa.int64()), pa.array(tokens, pa.int64())]
                if store:
                    columns.append(pa.array(stored, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "n_bytes", "n_tokens", *(["steps"] if store else [])]
    schema = f"`{key}` {kind}, n_bytes long, n_tokens long" + (", steps binary" if store else "")
    out = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
    return out.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *(["steps"] if store else []))
