"""Token counts by byte-pair merging with a heap and a linked list.

The count of a piece is its initial symbols less the merges that are carried out: the lowest-rank
adjacent pair (leftmost of equals) is merged again and again, and no identifiers are made.  The
vocabulary file gives merge ranks, special strings, and the end-of-word mark; its path is a
parameter, and files of another form are rejected.

A text is cut at white space, as no piece of this tokenizer spans it; counts of the cut strings
are remembered up to a bound, so each distinct string is merged about once for each worker.

Edge cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text count
one each, as in the library's default; nothing is truncated.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C

SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode white space
LIMIT = 2048
MEMO_CHARS = 64  # longer strings are counted each time


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes: itself where printable, else the next code from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def require_form(spec: dict) -> None:
    """Reject files whose normalizer, pieces or special strings differ from what is counted here."""
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    model = spec["model"]
    ok = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    ok = ok and [p["type"] for p in pre] == ["Split", "ByteLevel"] and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True) and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
    ok = ok and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"] for t in spec["added_tokens"])
    ok = ok and model["type"] == "BPE" and not (model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or model["dropout"] or model["unk_token"])
    if not ok:
        raise ValueError("counts are made for lower-case word-piece BPE files without further rules; this file has others")


class Merger(dict):
    """White-space-free string to its number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        require_form(spec)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.rank: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            self.rank.setdefault(tuple(pair), i)
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
        self.marks = tuple({s[:2] for s in special})
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # the pattern's \s is Unicode white space
        self.pieces = regex.compile(split.replace(r"\s", SPACE))
        self.cut = regex.compile(f"[^{SPACE}]+")
        self.symbols = byte_symbols()

    def merged(self, piece: str) -> int:
        sym = [self.symbols[b] for b in piece.encode()]
        sym[-1] += self.end
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap, left = self.rank, [], n
        for i in range(n - 1):
            if (r := rank.get((sym[i], sym[i + 1]))) is not None:
                heap.append((r, i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or sym[i] != a or sym[j] != b:
                continue  # the pair has changed meanwhile
            sym[i], sym[j] = a + b, ""
            nxt[i] = k = nxt[j]
            left -= 1
            if k < n:
                prv[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (h := prv[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return left

    def plain(self, s: str) -> int:
        # lower case is by code point in the library: no final sigma
        s = unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()
        return sum(self.merged(p) for p in self.pieces.findall(s))

    def __missing__(self, s: str) -> int:
        if any(m in s for m in self.marks) and self.special.search(s):
            n = len(self.special.findall(s)) + sum(self.plain(x) for x in self.special.split(s) if x)
        else:
            n = self.plain(s)
        if len(s) <= MEMO_CHARS:
            if len(self) > C.MEMO_LIMIT:
                self.clear()
            self[s] = n
        return n

    def count(self, text: str) -> int:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # str.split() would cut at these too
        return sum(map(self.__getitem__, self.cut.findall(text) if odd else text.split()))


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per document, no shuffle."""
    C.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path or default_path())
        for b in batches:
            texts = b.column(1).to_pylist()
            size = [len(t or b"") for t in texts]
            n = [m.count(t.decode("utf-8", "replace")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return C.text_bytes(docs, C.doc_id_col()).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_count(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
