"""Operator 6: BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import give_back

#: Chunks a worker remembers besides those of the block at hand; with more it keeps only what that block uses. Characters
#: of texts whose words are merged together.
REMEMBERED, BLOCK = 50_000, 1_000_000
#: Places of one pair beyond which they are merged as arrays.
MANY = 80
#: Stands before a special token among the chunks; no chunk of a text holds white space.
MARK = " "
_BLANKS = regex.compile(r"\p{White_Space}+")
#: Steps of normalising and splitting that treat stretches between white space one by one, so that they can be remembered.
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
#: The one form of these steps that has a quick way for plain chunks: those of visible ASCII and of letters below LETTERS that
#: the file's own steps only make lower case, each by itself, and take for letters. No two of them compose.
QUICK = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
LETTERS = 0x530
#: What str.split takes for white space besides.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A word BPE of the tokenizers library's JSON format: vocabulary, ranked merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if ([n["type"] for n in spec["normalizer"]["normalizers"]], [n["type"] for n in spec["pre_tokenizer"]["pretokenizers"]]) != STEPS:
            raise ValueError(f"{path} normalises or splits texts in another way than {STEPS}")
        rules = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalise, self.pieces = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        ids, letters, end = spec["model"]["vocab"], byte_alphabet(), spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain = self.quick = None
        if (spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]) == QUICK:
            own = "".join(sorted({x for c in map(chr, range(128, LETTERS)) if self.is_letter(c) for x in (c, c.lower())}))
            self.plain, self.quick = re.compile(f"[!-~{own}]+").fullmatch, re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{own}]+|[0-9]|[^a-z0-9{own}]+").findall
        #: The decimal id and the text of each token; last a line break, for the gaps of -1.
        self.digits, self.names = [*map(str, range(max(ids.values()) + 1)), "\n"], [""] * (max(ids.values()) + 1) + ["\n"]
        for t, i in ids.items():
            self.names[i] = t
        self.inner = np.array([ids[c] for c in letters], dtype=np.int32)
        self.final = np.array([ids[c + end] for c in letters], dtype=np.int32)
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in spec["model"]["merges"]]
        self.rank = {}
        for r, (a, b, _) in enumerate(self.merges):
            self.rank.setdefault(a << 20 | b, r)
        keys = sorted(self.rank)
        least = np.uint16 if len(self.merges) < 1 << 16 else np.int64  # arrays of 16 bits are sorted digit by digit
        self.keys, self.ranks = np.array(keys, dtype=np.int64), np.array([self.rank[k] for k in keys], dtype=least)
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: Of each chunk that is remembered: its decimal ids, the text of its tokens. Two maps to strings give the collector nothing to follow.
        self.known: dict[str, str] = {}
        self.read: dict[str, str] = {}

    def is_letter(self, c: str) -> bool:
        """Whether the file's steps make this character lower case as Python does, also at a word's end, and then go on with the word."""
        return self.normalise("a" + c) == ("a" + c).lower() and len(c.lower()) == 1 and len(self.pieces(f"a{c.lower()}a")) == 1

    def merge(self, words: list[str]) -> np.ndarray:
        """Token ids of all words, one word after the other, a -1 before, between and after them.

        All words' symbols lie in one row, a gap of -1 before, between and after them. The index maps the rank of
        each adjacent pair to its positions. The lowest active rank is applied at all its positions from left to
        right; each merge enters the pairs it makes with its neighbours, whose ranks become active. Long lists of
        positions (over MANY) are merged as arrays, short ones one by one through views of the same memory.
        """
        coded = [w.encode("utf-8") for w in words]
        flat = np.frombuffer(b"\0" + b"\0".join(coded) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(c) + 1 for c in coded])
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        symbols[ends] = symbols[0] = -1
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        places = np.nonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))[0]
        index: dict[int, list] = {}
        active: list[int] = []

        def enter(at: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
            pair = first.astype(np.int64) << 20 | second
            spot = np.searchsorted(self.keys, pair)
            spot[spot == len(self.keys)] = 0
            hit = self.keys[spot] == pair
            at, ranks = at[hit], self.ranks[spot[hit]]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            starts = [0, *(np.nonzero(np.diff(ranks))[0] + 1).tolist()] if len(ranks) else []
            for i, j in zip(starts, [*starts[1:], len(ranks)]):
                r = int(ranks[i])
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        enter(places, symbols[places], symbols[places + 1])
        sym, aft, bef = memoryview(symbols), memoryview(after), memoryview(before)
        rank_of, merges = self.rank.get, self.merges
        while active:
            r = heapq.heappop(active)
            a, b, c = merges[r]
            lists = index.pop(r)
            found = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            if len(found) > MANY and a != b:
                found = found[symbols[found] == a]
                follow = after[found]
                fits = symbols[follow] == b
                found, follow = found[fits], follow[fits]
                symbols[found], symbols[follow] = c, -2
                follow = after[follow]
                after[found], before[follow] = follow, found
                lead = before[found]
                left, right = symbols[lead], symbols[follow]
                there, here = left >= 0, right >= 0
                enter(
                    np.concatenate([lead[there], found[here]]),
                    np.concatenate([left[there], np.full(int(here.sum()), c, dtype=np.int32)]),
                    np.concatenate([np.full(int(there.sum()), c, dtype=np.int32), right[here]]),
                )
                continue
            for p in found.tolist():
                if sym[p] != a:
                    continue
                q = aft[p]
                if sym[q] != b:
                    continue
                sym[p], sym[q] = c, -2
                follow = aft[q]
                aft[p] = follow
                bef[follow] = p
                lead = bef[p]
                for at, new in ((p, rank_of(c << 20 | s) if (s := sym[follow]) >= 0 else None), (lead, rank_of(s << 20 | c) if (s := sym[lead]) >= 0 else None)):
                    if new is not None:
                        if new in index:
                            index[new].append(np.array([at]))
                        else:
                            index[new] = [np.array([at])]
                            heapq.heappush(active, new)
        return symbols[symbols != -2]

    def chunks(self, text: str) -> list[str]:
        """The text's stretches without white space, lowered if they are ASCII; a special token starts and ends a stretch of its own."""
        out: list[str] = []
        marked = self.split is not None and any(t in text for t in self.special)
        for part in self.split.split(text) if marked else (text,):
            if marked and part in self.special:
                out.append(MARK + part)
                continue
            whole = part.isascii()
            part = part.lower() if whole else part
            found = [c for c in _BLANKS.split(part) if c] if _SEPARATORS.search(part) else part.split()
            out += found if whole else [c.lower() if c.isascii() else c for c in found]
        return out

    def words(self, chunk: str) -> list[str]:
        """The words of a stretch, by the file's own normaliser and splitter, so that any Unicode character is what it is there; a plain stretch needs neither."""
        if self.plain is not None and self.plain(chunk):
            return self.quick(chunk.lower())
        text = chunk if chunk.isascii() else self.normalise(chunk)
        return [text[i:j] for _, (i, j) in self.pieces(text)]

    def learn(self, chunks: list[str]) -> None:
        """Enter the tokens of chunks that aren't known."""
        parts: list[str] = []
        counts = []
        for c in chunks:
            p = (c,) if c.startswith(MARK) else self.words(c)
            parts += p
            counts.append(len(p))
        words = list({w for w in parts if not w.startswith(MARK)})
        ids, texts = {MARK + t: str(i) for t, i in self.special.items()}, {MARK + t: t for t in self.special}
        if words:
            row = self.merge(words)[1:-1].tolist()
            for made, of in ((ids, self.digits), (texts, self.names)):
                made.update(zip(words, " ".join(map(of.__getitem__, row)).split(" \n ")))
        ends = list(itertools.accumulate(counts))
        for known, made in ((self.known, ids), (self.read, texts)):
            for c, n, j in zip(chunks, counts, ends):
                known[c] = made[parts[j - 1]] if n == 1 else " ".join(map(made.__getitem__, parts[j - n : j]))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of tokens, the decimal ids joined by one space, the decoded text."""
        split = [self.chunks(t) if t else [] for t in texts]
        used = {c for p in split for c in p}
        if len(self.known) > REMEMBERED:
            self.known, self.read = ({c: k for c, k in of.items() if c in used} for of in (self.known, self.read))
        known, read = self.known, self.read
        self.learn([c for c in used if c not in known])
        del used
        for p in split:
            if not p:
                yield 0, "", ""
                continue
            ids = " ".join(map(known.__getitem__, p))
            yield ids.count(" ") + 1, ids, " ".join(map(read.__getitem__, p))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """Ids and texts of rows with BLOCK characters together, or a row that alone has more."""
    doc_ids, texts, held = [], [], 0
    for b in batches:
        for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
            doc_ids.append(d)
            texts.append(t)
            held += len(t or "") + 64
            if held >= BLOCK:
                yield doc_ids, texts
                doc_ids, texts, held = [], [], 0
    if doc_ids:
        yield doc_ids, texts


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """Encode whole texts and decode them again.

    Gives doc_id, n_tokens, ids (array of int) and decoded; with `digests` the SHA-256 of the ids' decimal form
    and of the decoded text in their place. Null and empty texts have no tokens and decode to the empty text.
    A special token's string in a text is that token. Row by row: repeated ids and rows stay, other columns go.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        try:
            yield from encoded(v, sha, batches)
        finally:
            v.known, v.read = {}, {}  # the worker lives on, and other stages need its memory
            give_back()

    def encoded(v: Vocabulary, sha, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc_ids, texts in blocks(batches):
            rows = v.encode(texts)
            if digests:
                yield pd.DataFrame([(d, n, sha(i), sha(t)) for d, (n, i, t) in zip(doc_ids, rows)], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                continue
            while some := list(itertools.islice(rows, 256)):
                here, doc_ids = doc_ids[: len(some)], doc_ids[len(some) :]
                yield pd.DataFrame({"doc_id": here, "n_tokens": [r[0] for r in some], "ids": [np.array(r[1].split(), dtype=np.int32) for r in some], "decoded": [r[2] for r in some]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))
