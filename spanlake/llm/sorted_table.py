"""Strings with numbers in sorted files that executors map into memory: a vocabulary of any size, as a mapping and as a trie."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame


class SortedTable:
    """Read-only mapping of strings to numbers over the files `name`.text (the strings, sorted by their UTF-8 bytes, without breaks),
    `name`.ends and `name`.counts of the session's files. Only what is looked up is read; answers are kept, up to KEPT."""

    KEPT = 500_000

    def __init__(self, name: str):
        self.name, self.memo, self.size = name, {}, None

    def _open(self) -> None:
        import mmap

        import numpy as np
        from pyspark import SparkFiles

        path = SparkFiles.get(self.name)
        self.ends = np.memmap(f"{path}.ends", dtype=np.int64, mode="r")  # begins with a 0, so it is never empty
        self.counts = np.memmap(f"{path}.counts", dtype=np.int64, mode="r")  # ends with a 0
        self.size = len(self.ends) - 1
        with open(f"{path}.text", "rb") as f:
            self.text = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(f.name) else b""

    def __len__(self) -> int:
        if self.size is None:
            self._open()
        return self.size

    def at(self, i: int) -> bytes:
        return self.text[self.ends[i] : self.ends[i + 1]]

    def place(self, x: bytes, lo: int, hi: int) -> int:
        """The first place from lo to hi whose string isn't below x."""
        while lo < hi:
            mid = (lo + hi) // 2
            if self.at(mid) < x:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def get(self, word: str, default: int | None = None) -> int | None:
        if word not in self.memo:
            if len(self.memo) >= self.KEPT:
                self.memo.clear()
            x = word.encode()
            i = self.place(x, 0, len(self))
            self.memo[word] = int(self.counts[i]) if i < len(self) and self.at(i) == x else None
        n = self.memo[word]
        return default if n is None else n

    def __contains__(self, word: str) -> bool:
        return self.get(word) is not None

    def __getitem__(self, word: str) -> int:
        n = self.get(word)
        if n is None:
            raise KeyError(word)
        return n

    def items(self) -> Iterator[tuple[str, int]]:
        return ((self.at(i).decode(), int(self.counts[i])) for i in range(len(self)))


class Node:
    """A prefix and the places of the strings that begin with it; behaves as a node of Trie. Strings other than words of three letters and more have no weight."""

    __slots__ = ("table", "prefix", "lo", "hi", "kids", "whole")

    def __init__(self, table: SortedTable, prefix: bytes, lo: int, hi: int):
        self.table, self.prefix, self.lo, self.hi, self.kids, self.whole = table, prefix, lo, hi, {}, False

    def __contains__(self, c: str) -> bool:
        return self.get(c) is not None

    def __getitem__(self, c: str):
        return self.get(c)

    def get(self, c: str):
        if c not in self.kids:
            t = self.table
            if c == "":
                own = self.lo < self.hi and t.at(self.lo) == self.prefix
                word = self.prefix.decode() if own else ""
                self.kids[c] = int(t.counts[self.lo]) if len(word) > 2 and word.isalpha() else None
            elif self.whole:
                return None
            else:
                x = self.prefix + c.encode()
                lo = t.place(x, self.lo, self.hi)
                hi = t.place(x + b"\xff", lo, self.hi)  # no UTF-8 has this byte
                self.kids[c] = Node(t, x, lo, hi) if lo < hi else None
        return self.kids[c]

    def items(self) -> list[tuple[str, Node]]:
        if not self.whole:
            t, k = self.table, len(self.prefix)
            i = self.lo + (self.lo < self.hi and t.at(self.lo) == self.prefix)
            while i < self.hi:
                c = t.at(i)[k : k + 4].decode(errors="ignore")[0]
                child = self.get(c)
                i = child.hi
            self.whole = True
        return [(c, child) for c, child in self.kids.items() if c and child is not None]


class SortedTrie:
    """Trie of the words of a SortedTable; its nodes are made as they are visited and dropped after `visits` tokens."""

    def __init__(self, table: SortedTable, visits: int = 2000):
        self.table, self.visits, self.left, self.top = table, visits, 0, None

    @property
    def root(self) -> Node:
        if self.left == 0:
            self.top, self.left = Node(self.table, b"", 0, len(self.table)), self.visits
        self.left -= 1
        return self.top


def sorted_table(rows: DataFrame, name: str) -> SortedTable:
    """rows(word, n), distinct words, as a SortedTable. The rows pass through the driver one by one; each executor fetches the files once."""
    import atexit
    import shutil
    import tempfile
    import uuid

    spark = rows.sparkSession
    name = f"{name}-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="spanlake-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, name)
    with open(f"{path}.text", "wb") as text, open(f"{path}.ends", "wb") as ends, open(f"{path}.counts", "wb") as counts:
        end = 0
        array("q", [0]).tofile(ends)
        for r in rows.select("word", "n").orderBy("word").toLocalIterator():
            x = r.word.encode()
            end += len(x)
            text.write(x)
            array("q", [end]).tofile(ends)
            array("q", [r.n]).tofile(counts)
        array("q", [0]).tofile(counts)
    for kind in ("text", "ends", "counts"):
        spark.sparkContext.addFile(f"{path}.{kind}")
    return SortedTable(name)
