"""License scans: matching statistics against a generalised suffix automaton of licence templates, chained into spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import buffers, word_hashes
from palimpsest.llm.templates import TEMPLATES

#: Tokens of the shortest match that chains; tokens that a chain may skip in the text or in the template; share of a template, or tokens, that make a finding.
LEAST, GAP, COVERED, ENOUGH = 4, 10, 0.75, 60


def tokens(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text in lower case."""
    data, offsets = buffers(pc.utf8_lower(pa.array(texts, pa.string())))
    words, at = word_hashes(data, offsets)
    return [words[a:b] for a, b in zip(at[:-1], at[1:])]


class Automaton:
    """The smallest automaton of all suffixes of several token sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.sequences = sequences
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((k, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]
        self.places = [sorted(e) if n >= LEAST else [] for e, n in zip(self.ends, self.length)]

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def matches(self, seq: list[int]) -> list[tuple[int, int, int, int]]:
        """(start in seq, template, start there, length) of all matches of LEAST tokens or more that can't be extended to either side.

        Streams seq once; the state is that of the longest suffix that matches. A place of a template
        ends with its longest match where the next token of the template isn't that of seq.
        """
        out = []
        state = size = 0
        follow, link, length, places, seqs = self.next, self.link, self.length, self.places, self.sequences
        for i, c in enumerate([*seq, -1]):
            if size >= LEAST:
                s, seen = state, set()
                while s and (n := min(size, length[s])) >= LEAST:
                    for at in places[s]:
                        if at not in seen:
                            seen.add(at)
                            k, e = at
                            if e == len(seqs[k]) or seqs[k][e] != c:
                                out.append((i - n, k, e - n, n))
                    s = link[s]
            while state and c not in follow[state]:
                state = link[state]
                size = length[state]
            if c in follow[state]:
                state, size = follow[state][c], size + 1
        return out


def chains(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(template, start, end, covered tokens) of the best chains of matches of one template.

    In a chain both places go up and no more than GAP tokens are skipped in the text or the
    template; what overlaps counts once. Chains are taken by covered tokens, none overlapping.
    """
    by: dict[int, list[tuple[int, int, int]]] = {}
    for d, k, t, n in matches:
        by.setdefault(k, []).append((d, t, n))
    out = []
    for k, ms in by.items():
        ms = sorted(set(ms))
        best, back = [n for _, _, n in ms], [-1] * len(ms)
        open_: list[int] = []
        for i, (d, t, n) in enumerate(ms):
            open_ = [j for j in open_ if ms[j][0] + ms[j][2] + GAP >= d]
            for j in open_:
                d2, t2, n2 = ms[j]
                skip = max(0, d2 + n2 - d, t2 + n2 - t)
                if d2 < d and t2 < t and skip < n and t - (t2 + n2) <= GAP and best[j] + n - skip > best[i]:
                    best[i], back[i] = best[j] + n - skip, j
            open_.append(i)
        used: set[int] = set()
        for i in sorted(range(len(ms)), key=lambda i: (-best[i], i)):
            path, j = [], i
            while j >= 0 and j not in used:
                path.append(j)
                j = back[j]
            if j >= 0:
                continue
            used.update(path)
            out.append((k, ms[path[-1]][0], ms[i][0] + ms[i][2], best[i]))
    return out


class Scanner:
    """The templates, their vocabulary and automaton."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        seqs = tokens([templates[n] for n in self.names])
        self.vocabulary = np.unique(np.concatenate([*seqs, np.zeros(0, np.uint64)]))
        self.sizes = [len(s) for s in seqs]
        self.automaton = Automaton([np.searchsorted(self.vocabulary, s).tolist() for s in seqs])

    def spans(self, words: np.ndarray) -> list[tuple[str, int, int, int, float]]:
        """(licence, first token, token after the last, covered tokens, share of the template) of the findings in a text.

        Only runs of template words are streamed, as any other word ends every match.
        """
        if not len(self.vocabulary) or len(words) < LEAST:
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        found = []
        for a, b in zip(starts[ends - starts >= LEAST].tolist(), ends[ends - starts >= LEAST].tolist()):
            found += [(a + d, k, t, n) for d, k, t, n in self.automaton.matches(at[a:b].tolist())]
        if not found:
            return []
        good = [c for c in chains(found) if c[3] >= min(ENOUGH, COVERED * self.sizes[c[0]])]
        out: list[tuple[str, int, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        for k, a, b, n in sorted(good, key=lambda c: (-c[3], -c[3] / self.sizes[c[0]], self.names[c[0]], c[1])):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((self.names[k], a, b, n, n / self.sizes[k]))
        return sorted(out, key=lambda s: s[1])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_token, end_token, covered, share): the licence notices in all documents.

    Texts and templates are compared word by word in lower case. Chains that cover COVERED of a
    template, or ENOUGH of its tokens, are findings; where findings overlap the one that covers most
    is kept (ties: the greater share, then the name). The templates are part of this package and
    go to the workers with the code; their automaton is built once per task.

    Null, empty and wordless texts have no finding. A null doc_id is reported as null, repeated rows
    are each reported, a notice that occurs twice is found twice. An empty table gives no rows.
    Whole texts are read; other columns are not.
    """
    chosen = TEMPLATES if templates is None else templates

    def scan(batches):
        scanner = Scanner(chosen)
        for batch in batches:
            data, offsets = buffers(pc.utf8_lower(batch.column("text")))
            words, at = word_hashes(data, offsets)
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r], *span) for r in range(len(ids)) for span in scanner.spans(words[at[r] : at[r + 1]])]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "first_token", "end_token", "covered", "share"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return slim.mapInArrow(scan, "doc_id long, license string, first_token int, end_token int, covered int, share double")
