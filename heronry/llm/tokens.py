"""Token ids of whole texts, by a cache of the runs between blanks."""

from __future__ import annotations

import numpy as np

from .common import in_workers

#: Bytes of runs and ids that a worker's cache may hold.
HELD_BYTES = 24_000_000
#: Bytes of text that are cut at once.
BYTES_AT_ONCE = 4_000_000
_HELD: dict = {}


def tokenizer(path: str, blanks: bool = True) -> RunTokenizer:
    """This process's tokenizer of that file; Spark's Python workers serve many tasks."""
    if (path, blanks) not in _HELD:
        _HELD[path, blanks] = RunTokenizer(path, blanks)
    return _HELD[path, blanks]


def _expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of lengths[i] elements, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


class RunTokenizer:
    """Ids of texts under a tokenizer that lower-cases, replaces white space and never joins across it.

    A batch is cut at spaces and line feeds, and its distinct runs are found in Arrow; these are looked up in the
    cache, and new ones encoded, many in one text, where the ids' offsets tell which run they belong to. A cache of
    more than `limit` bytes is cut down to the runs of the last batch. The result equals encoding the whole text.
    Other tokenizers need blanks=False: whole texts are encoded.
    """

    def __init__(self, path: str, blanks: bool = True, limit: int = HELD_BYTES):
        in_workers()
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks, self.limit = Tokenizer.from_file(path), blanks, limit
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.runs = pa.array([], pa.large_string())
        self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, self.type)
        self.marks = [self._whole([m])[0] for m in ",."] if blanks else []

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(x.ids, self.type) for x in encode(texts, add_special_tokens=False)]

    def _encoded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each run has, and the ids one after the other."""
        lengths, ids = [], []
        groups, size = [[]], 0
        for run in runs:  # special tokens, and runs that fill a text of their own, stand alone
            if size > 2048 or "<|" in run:
                groups.append([])
                size = 0
            groups[-1].append(run)
            size += len(run) + (4096 if "<|" in run else 1)
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, found in zip(part, self.tokenizer.encode_batch([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
                at_char = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
                lengths.append(np.diff(np.searchsorted(at_char, ends), prepend=0))
                ids.append(np.array(found.ids, self.type))
        none = np.zeros(0, self.type)
        return np.concatenate([none, *lengths]).astype(np.int64), np.concatenate([none, *ids])

    def _known(self, runs) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct runs start in the pool, and how many they are."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(runs, value_set=self.runs)
        new = runs.filter(pc.is_null(at))
        if len(new):
            lengths, ids = self._encoded(new.to_pylist())
            self.runs = pa.concat_arrays([self.runs, new])
            self.lengths, self.pool = np.append(self.lengths, lengths), np.append(self.pool, ids)
            at = pc.index_in(runs, value_set=self.runs)
        at, starts = at.to_numpy(), np.cumsum(self.lengths) - self.lengths
        if self.runs.nbytes + self.lengths.nbytes + self.pool.nbytes > self.limit:
            lengths = self.lengths[at]
            self.pool, self.runs, self.lengths = self.pool[_expanded(starts[at], lengths)], runs, lengths
            return np.cumsum(lengths) - lengths, lengths
        return starts[at], self.lengths[at]

    def __call__(self, texts):
        """texts: an Arrow array of strings. Yields (first text, ids, counts of ids by text) for parts of it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            # Taken, not sliced: ascii_lower reads the wrong bytes of a slice.
            own = pc.fill_null(texts.cast(pa.large_string()).take(pa.array(np.arange(a, b))), "")
            if not self.blanks:
                ids = self._whole(own.to_pylist())
                yield a, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
                continue
            # Special tokens are matched with their case.
            own = pc.if_else(pc.match_substring(own, "<|"), own, pc.ascii_lower(own))
            cut = pc.split_pattern(pc.replace_substring(own, "\n", " "), " ")
            runs = cut.flatten().dictionary_encode()
            codes, distinct = runs.indices.to_numpy(), runs.dictionary
            # A comma or full stop after a letter, at the end of a run, is a token of its own either way.
            marked = pc.match_substring_regex(distinct, r"\pL[.,]$")
            stems = pc.if_else(marked, pc.utf8_slice_codeunits(distinct, 0, stop=-1), distinct).dictionary_encode()
            starts, lengths = (x[stems.indices.to_numpy()] for x in self._known(stems.dictionary))
            marked = marked.to_numpy(zero_copy_only=False)
            pool, mark = self._with_marks(starts, lengths, marked, pc.ends_with(distinct, ".").to_numpy(zero_copy_only=False))
            each = mark[1][codes]
            ids = pool[_expanded(mark[0][codes], each)]
            ends = np.append(0, np.cumsum(each))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
            yield a, ids, np.diff(ends)

    def _with_marks(self, starts, lengths, marked, full_stop):
        """A pool of the distinct runs' ids with those of their marks; starts and lengths in it."""
        comma, stop = self.marks
        total = lengths + marked
        at = np.cumsum(total) - total
        pool = np.empty(int(total.sum()), self.type)
        pool[_expanded(at, lengths)] = self.pool[_expanded(starts, lengths)]
        pool[(at + lengths)[marked]] = np.where(full_stop, stop[0], comma[0])[marked]
        return pool, (at, total)
