"""BPE encoding and decoding by a prefix-sharing trie traversal.

Texts are cut at white space, which no word goes beyond, and each distinct run is encoded once while a worker keeps it.
The distinct words of the new runs, sorted, are the depth-first order of their trie: a word shares with the one
before it the path of their common prefix. A node's state is the last token of the encoding of the prefix that
leads to it. It follows from the states above: of the tokens that end the prefix, it is the one that may stand
after the last token of what remains, that is, whose pair with that token is left as it is by the merges. So
the encoding of a prefix is computed once for all words that begin with it, and a word's tokens are read by
walking back from its end. A word's last symbol carries the end-of-word mark and so is an edge of its own.

The vocabulary file is a parameter (`public_tokenizers.path("word_bpe_49k.json")` in the query) and is read
by each worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import give_back, held, row_key, table, text_slices

#: Runs of text between white space whose encodings a worker keeps, and their characters; it starts anew beyond either.
CACHE_RUNS = 500_000
CACHE_CHARS = 12_000_000
#: Pairs of tokens of which a worker keeps whether they merge.
CACHE_PAIRS = 400_000
#: Bytes of text that are encoded together.
STEP_BYTES = 1 << 20
#: White space of the normaliser's and the splitter's \\s.
_WS = r"\t-\r \x85\xa0  -     　"


#: What stands before an added token and before a word that is not to be split again; no run has white space.
_ADDED, _WORD = " a", " w"


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next free code point from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def _runs(points: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    first = last = None
    for c in points:
        if last is not None and c == last + 1:
            last = c
            continue
        if first is not None:
            yield first, last
        first = last = c
    if first is not None:
        yield first, last


class TrieBpe:
    """A word BPE with an end-of-word mark, as its JSON file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # a word's inner tokens, and those that end it without their mark; in inner, what only begins a token has an empty one
        inner = {t: t for t in self.ids if not t.endswith(self.mark)}
        self.final = {t[: -len(self.mark)]: t for t in self.ids if t.endswith(self.mark)}
        self.inner = {t[:k]: "" for t in chain(inner, self.final) for k in range(1, len(t) + 1)} | inner
        self.letters = _byte_letters()
        self.special = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.blank = regex.compile(f"[{_WS}]+")
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
        # code points that this Python's Unicode tables do not have: the library's, which may be newer, decide on them
        unknown = [c for c in range(0x378, 0x110000) if unicodedata.category(chr(c)) == "Cn"]
        runs = [(a, b) for a, b in _runs(unknown)]
        self.newer = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]")
        self.controls = re.compile("[\x1c-\x1f]")  # white space to Python, not to the splitter
        self.beyond = regex.compile(r"[\u0378-\U0010ffff]")
        self.path, self.pattern = path, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.library = None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.wholes: dict[str, bool] = {}  # one entry for each token at most
        self.ids_of: dict[str, tuple[str, ...]] = {}
        self.by_id = {str(i): t for t, i in (self.ids | self.added).items()}
        self.id_text = {t: str(i) for t, i in self.ids.items()}
        self.again: set[str] = set()
        self.chars = 0

    # ---- merges

    def _symbols(self, token: str) -> list[str]:
        """The symbols that a token is merged from."""
        if token.endswith(self.mark) and len(token) > len(self.mark):
            body = token[: -len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the first of the pairs with the lowest rank merges, until none is left."""
        s, rank, none = list(symbols), self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(s, s[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            s[k : k + 2] = [s[k] + s[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((s[k - 1], s[k]), none)
            if k < len(ranks):
                ranks[k] = rank((s[k], s[k + 1]), none)
        return s

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the merges leave the tokens left and right as they are, side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self._symbols(left) + self._symbols(right)) == [left, right]
        return known

    # ---- the traversal

    def whole(self, token: str) -> bool:
        """Whether the merges make this token of its symbols."""
        known = self.wholes.get(token)
        if known is None:
            known = self.wholes[token] = self.merged(self._symbols(token)) == [token]
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[str, ...]]:
        """Ids, in decimal, of each word, written in byte letters. Depth first over the words' trie; states[d] is the last
        token of the prefix of d symbols, where that token starts, and the first place from which the rest of the prefix
        begins a token: no token of a longer prefix starts before it."""
        inner, final, pairs, wholes, id_text = self.inner, self.final, self.pairs, self.wholes, self.id_text
        out: dict[str, tuple[str, ...]] = {}
        before, states = "", [("", 0, 0)]
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[min(shared, n - 1) + 1 :]
            low = states[-1][2]
            for depth in range(len(states), n + 1):
                last = depth == n  # the last symbol carries the mark
                for start in range(low, depth):
                    token = final.get(word[start:depth]) if last else inner.get(word[start:depth])
                    if not token:
                        if start == low and token is None:
                            low += 1
                        continue
                    if start:
                        left = states[start][0]
                        fits = pairs.get((left, token))
                        if fits is None:
                            fits = self.may_follow(left, token)
                    else:
                        fits = depth == 1 or wholes.get(token)
                        if fits is None:
                            fits = self.whole(token)
                    if fits:
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                if not last:
                    states.append((token, start, low))
            tokens = [id_text[token]]
            while start:
                token, start, _ = states[start]
                tokens.append(id_text[token])
            tokens.reverse()
            out[word] = tuple(tokens)
            before = word
        return out

    # ---- texts

    def runs(self, text: str) -> list[str]:
        """Parts of a text in order, none of which a word goes beyond: the lowered runs between white space, or, marked,
        added tokens and words."""
        if self.special is not None and "<|" in text:
            out: list[str] = []
            at = 0
            for m in self.special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(_ADDED + m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if self.beyond.search(text) and self.newer.search(text):
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one: no final sigma
        if self.controls.search(text):
            return self.blank.sub(" ", text).lower().split(" ")
        return text.lower().split()  # the same white space, as there are no controls

    def _by_library(self, text: str) -> list[str]:
        """The words as the library's normaliser and splitter find them."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(self.pattern), "removed", True)
        normal, split = self.library
        return [_WORD + w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def learn(self, runs: set[str]) -> None:
        """Encodes the runs that aren't known yet: all their distinct words in one traversal."""
        ids = self.ids_of
        met = runs & ids.keys()
        new = runs - met
        size = sum(map(len, new))
        if len(ids) + len(new) > CACHE_RUNS or self.chars + size > CACHE_CHARS:
            # what was met in several steps stays, unless that is too much as well
            keep = (self.again & ids.keys()) | met
            if 2 * len(keep) > CACHE_RUNS or 2 * sum(map(len, keep)) > CACHE_CHARS:
                keep = met
            self.ids_of = ids = {r: ids[r] for r in keep}
            self.chars, self.again = sum(map(len, keep)), set()
        self.again |= met
        self.chars += size
        words = {r: self._words(r) for r in new if not r.isalpha()}
        missing = {w for found in words.values() for w in found if w not in ids}  # a word by itself is a run, too
        missing.update(r for r in new if r not in words)
        plain = {w: w.encode().decode("latin-1").translate(self.letters) for w in missing if not (w.isascii() and w.isprintable())}
        known = self.encode_words({plain.get(w, w) for w in missing})
        ids_of_word = {w: known[plain.get(w, w)] for w in missing}
        for r in new:
            if r not in words:
                ids[r] = ids_of_word[r]
            elif r.startswith(_ADDED):
                ids[r] = (str(self.added[r[len(_ADDED) :]]),)
            else:
                ids[r] = tuple(chain.from_iterable([ids_of_word.get(w) or ids[w] for w in words[r]]))

    def _words(self, run: str) -> list[str]:
        """The words of a run that is no added token; of letters followed by one ASCII mark it's plain without a search."""
        if run.startswith(_WORD):
            return [run[len(_WORD) :]]
        if run.startswith(_ADDED):
            return []
        if run and run[-1] in string.punctuation and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return self.split.findall(run)

    def coded(self, texts: list[str]) -> list[list[str]]:
        """The ids of each text, in decimal."""
        found = [self.runs(t) if t else [] for t in texts]
        self.learn(set().union(*found))
        return [list(chain.from_iterable(map(self.ids_of.__getitem__, runs))) for runs in found]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.coded([text])[0]]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return self.decoded([str(i) for i in ids])

    def decoded(self, ids: list[str]) -> str:
        return " ".join(filter(None, map(self.by_id.get, ids)))


def _steps(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about STEP_BYTES of text."""
    for i, j, _, _ in text_slices(column, STEP_BYTES):
        yield i, j


def _encode(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(f"bpe {path}", lambda: TrieBpe(path))
        for batch in batches:
            for at, end in _steps(batch.column("text")):
                part = batch.slice(at, end - at)
                ids = bpe.coded([t or "" for t in part.column("text").to_pylist()])
                tokens = list(map(bpe.decoded, ids))
                cols = [pa.array(list(map(len, ids)), pa.int64())]
                cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs]) for xs in (map(" ".join, ids), tokens)]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    cols += [pa.array([list(map(int, x)) for x in ids], pa.list_(pa.int32())), pa.array(tokens)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in ("doc_id", "k_id", "k_hash")] + cols, names=["doc_id", "k_id", "k_hash", *names])
            give_back()

    return run


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, k_id, k_hash, n_tokens, ids_sha256, decoded_sha256; full: ids and decoded too.

    A null text is empty and has no tokens. Rows may repeat, ids may be null; other columns are not read. There
    is no shuffle: each worker builds the trie of its own batches' distinct words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", *row_key())
    schema = "doc_id long, k_id long, k_hash long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return rows.mapInArrow(_encode(vocabulary, full), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(table(spark, sf_dir, "documents"), default_vocabulary())
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
