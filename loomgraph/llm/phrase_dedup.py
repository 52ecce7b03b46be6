"""Substring deduplication by repeated-phrase automata.

A window is ``window`` consecutive words of one document.  Windows that occur
earlier in the corpus (in a document with a smaller id, or earlier in the same
one) cover words that are removed.

Documents are cut into passages around the phrases of ``PHRASE`` words that
recur anywhere, and passages that may share a window meet as text in one shard
(see ``repeats``).  In each shard

1. recurring passages are confirmed: windows of equal hashes are nominated;
2. windows that occur only together are one passage; passages are compiled into
   sharded Aho-Corasick automata, one character a word (words are numbered by
   their bytes), ``PHRASES`` of them in each;
3. the passages of all documents stream through every automaton of the shard.
   Its hits are the only source of occurrences, and they are exact.  Where a
   nominated window has no hit, windows share a hash only; then each is
   compiled by itself, until all are located.

A document needs to meet only the automata of shards that hold a phrase of its
own, so text that cannot recur is not sent, and work grows with the input.

Defined cases: a null text has no words; texts shorter than a window lose
nothing; a null ``doc_id`` counts as larger than any id; of rows with equal
ids the one read first counts as earlier; exact copies lose all their windows
but the first document's; an empty table gives no rows; the text column alone
is looked at; of columns kept along none may be called extra.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import U, covered, find_anchors, gram_hashes, mix, words_of
from .blocks import Block, ask, finish, make_blocks, shard_count
from .repeats import Symbols, Windows, answer_anchors, answer_snippets, ask_anchors, ask_snippets, repeated_windows
from .tokens import ragged_take

#: Words of an anchor phrase.
PHRASE = 4
#: Phrases in one automaton.
PHRASES = 50_000
#: Characters that a word may be coded by: two, if there are more words; surrogates are left out.
ALPHABET = 1_000_000


class Words:
    """The words of a block's documents, with ``content`` as the block's words one blank apart."""

    def __init__(self, block: Block):
        joined = b"\n".join([block.buffer[a:b] for a, b in zip(block.starts, block.ends)]) + b"\n"
        begin, end, symbols = words_of(joined)
        shift = np.searchsorted(block.starts + np.arange(len(block)), begin, side="right") - 1
        self.begin, self.end = begin - shift, end - shift
        self.first = np.searchsorted(self.begin, block.starts, side="left")
        self.last = np.searchsorted(self.begin, block.ends, side="left")
        self.counts = self.last - self.first
        edges = np.concatenate([[0], np.cumsum(end - begin + 1)])
        raw = np.frombuffer(joined, np.uint8)[ragged_take(begin, end - begin + 1)]
        raw[edges[1:] - 1] = 32
        self.content = Symbols(symbols, self.first, self.last, raw, edges)


def windows_of(length: int) -> Windows:
    return Windows(lambda block: Words(block).content, length, min(PHRASE, length), True)


def _coded(text: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, int]:
    """The passages with a character or two for each word, the words' numbers, and the characters of a word.

    ``ends`` are the ends of all words, blanks included; a zero character follows each passage.
    """
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(text)])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    width = 1 if codes.max(initial=0) < ALPHABET - 1 else 2
    half = ALPHABET // 2
    marks = (codes + 1)[:, None] if width == 1 else np.stack([codes // (half - 1) + 1, codes % (half - 1) + half], axis=1)
    marks = (marks + (marks >= 0xD800) * 0x800).astype("<u4")
    passage = np.cumsum(sizes)
    at = np.arange(len(codes)) + np.searchsorted(passage, ends, side="left")
    line = np.zeros((len(codes) + len(sizes), width), "<u4")
    line[at] = marks
    return line.tobytes().decode("utf-32-le"), codes, width


def locate(text: np.ndarray, sizes: np.ndarray, counts: np.ndarray, keys: np.ndarray, copied: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of the passages that recurs, the same for equal ones; -1 for those that no automaton finds."""
    import ahocorasick

    ends = np.flatnonzero(text == 32) + 1
    line, codes, width = _coded(text, sizes, ends)
    n_words = counts + length - 1
    first_word = np.cumsum(n_words) - n_words
    start = ragged_take(first_word, counts)  # of each window
    place = start + np.repeat(np.arange(len(counts)), counts)  # with the zero characters in front of it
    group = np.full(len(start), -1, np.int64)
    hashes = gram_hashes(mix(codes.astype(np.uint64) + U(1)), length)[start]
    unique, inverse, often = np.unique(hashes, return_inverse=True, return_counts=True)
    often = (often > 1) | (np.bincount(inverse, np.repeat(copied, counts), len(unique)) > 0)
    todo = np.flatnonzero(often[inverse])
    window_at = np.full(len(line) // width + 1, -1, np.int64)
    window_at[place] = np.arange(len(start))

    def stream(picked: np.ndarray, runs: np.ndarray, base: np.ndarray) -> None:
        """Compile the runs of windows that begin at ``picked`` and number what the automata find from ``base`` on."""
        for at in range(0, len(picked), PHRASES):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            first, size = place[picked[at : at + PHRASES]] * width, (runs[at : at + PHRASES] + length - 1) * width
            for k, (x, n) in enumerate(zip(first.tolist(), size.tolist())):
                automaton.add_word(line[x : x + n], at + k)
            automaton.make_automaton()
            hits = np.fromiter(automaton.iter(line), np.dtype([("end", np.int64), ("phrase", np.int64)]))
            phrase = hits["phrase"]
            found = window_at[(hits["end"] + 1) // width - length + 1 - runs[phrase]]
            group[ragged_take(found, runs[phrase])] = ragged_take(base[phrase], runs[phrase])

    picked, runs = _chains(inverse, todo, counts)
    stream(picked, runs, np.cumsum(runs) - runs)
    if len(todo) and (group[todo] < 0).any():  # some windows share a hash only: each by itself
        group[:] = -1
        known = 0
        while len(todo):
            picked = todo[np.unique(inverse[todo], return_index=True)[1]]  # one window of each hash
            stream(picked, np.ones(len(picked), np.int64), known + np.arange(len(picked)))
            known += len(picked)
            todo = todo[group[todo] < 0]
    return group


def _chains(kind: np.ndarray, todo: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows that occur only together, as first windows and numbers of windows.

    ``kind`` numbers windows by hash, ``todo`` are the nominated ones.  Where
    each window of one kind is followed by one of another that occurs as often,
    the two are parts of one longer passage.
    """
    n = int(kind.max(initial=-1)) + 1
    nominated = np.zeros(len(kind) + 1, bool)
    nominated[todo] = True
    last = np.zeros(len(kind), bool)
    last[np.cumsum(counts) - 1] = True  # of its passage
    after = np.append(kind[1:], -1)
    after = np.where(last | ~nominated[1:], -1, after)[todo]
    own = kind[todo]
    low, high = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    np.minimum.at(low, own, after)
    np.maximum.at(high, own, after)
    often = np.bincount(own, minlength=n)
    linked = (low == high) & (low >= 0)
    linked[linked] = often[linked] == often[low[linked]]
    first = np.full(n, len(kind), np.int64)
    np.minimum.at(first, own, todo)
    lead = todo[first[own] == todo]  # the first window of each kind; of linked kinds they follow each other
    ends = ~linked[kind[lead]]
    begins = np.ones(len(lead), bool)
    begins[1:] = ends[:-1]
    return lead[begins], np.flatnonzero(ends) - np.flatnonzero(begins) + 1


def repeated_words(block: Block, given: list[dict[int, bytes]], shards: int, window: int) -> tuple[Words, np.ndarray]:
    """The words of a block, and which of them are removed."""
    words = Words(block)
    _, gone = repeated_windows(Windows(lambda _: words.content, window, min(PHRASE, window), True), block, given, shards)
    return words, covered(gone, window, len(words.begin))


def remove_repeats(docs: DataFrame, window: int = 20, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, text) and the columns of ``keep``.

    Texts that lose nothing stay as they are; of others, the runs of words
    that are left follow each other after one blank.
    """
    names = ["doc_id", "n_words", "n_removed", "text", *(keep or [])]
    windows = windows_of(window)

    def rows(block: Block, given: list, shards: int) -> pa.RecordBatch:
        words, gone = repeated_words(block, given, shards, window)
        removed = np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed[words.last] - removed[words.first]
        texts = []
        for i, (a, b) in enumerate(zip(words.first, words.last)):
            if not n_removed[i]:
                texts.append(block.buffer[block.starts[i] : block.ends[i]])
                continue
            step = np.diff(np.concatenate([[1], gone[a:b], [1]]).astype(np.int8))
            runs = zip(words.begin[a + np.flatnonzero(step < 0)], words.end[a + np.flatnonzero(step > 0) - 1])
            texts.append(b" ".join([block.buffer[x:y] for x, y in runs]))
        return pa.RecordBatch.from_arrays([block.ids(), pa.array(words.counts), pa.array(n_removed), pa.array(texts, pa.binary()).cast(pa.string()), *block.kept.values()], names)

    def anchors(block: Block) -> np.ndarray:
        c = Words(block).content
        return find_anchors(c.symbols, c.first, c.last, windows.gram, window)

    def judge(text, sizes, counts, keys, copied) -> np.ndarray:
        return locate(text, sizes, counts, keys, copied, window)

    blocks = make_blocks(docs, anchors, keep)
    shards = shard_count(blocks)
    hot = ask(blocks, [], lambda b, given, n: ask_anchors(windows, b, n), answer_anchors, "repeated-phrases", shards)
    located = ask(blocks, [hot], lambda b, given, n: ask_snippets(windows, b, given, n), lambda e: answer_snippets(windows, e, judge, True), "repeated-windows", shards)
    kinds = dict(docs.dtypes)
    fields = "".join(f", `{c}` {kinds[c]}" for c in keep or [])
    return finish(blocks, [hot, located], rows, "doc_id long, n_words long, n_removed long, text string" + fields, shards)
