"""A run-length index of byte strings: the Burrows-Wheeler transform kept as runs, with text positions sampled at
run ends, and matching statistics streamed through it for many patterns in step.

What the index keeps per row of the transform is its run and its interval, rows whose suffixes agree on `depth` symbols:
a bit each marks the rows where one begins, and counting bits tells which a row lies in. A value per string (here the smallest
document that holds it) is kept as the minimum per interval, so one row of a full match tells the smallest document
that holds the matched symbols. So the index follows the number of runs and of different stretches of `depth` symbols;
row by row it keeps nothing but the text itself, in bytes, and these bits.

A pattern is foreign to the index: it is read from its end, and where the run of the current row does not go on with
the pattern's symbol, the walk moves to the nearest run that does, before or behind, whichever end agrees longer with the match
so far; the positions sampled there tell how long.
"""

import numpy as np

PACKED = 21
#: Symbols that are compared first: most suffixes differ there.
NEAR = 8
#: Masks of the bits up to each of a word.
UP_TO = (np.uint64(2) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def _marks(rows, n):
    """A bit per row, set for the given ones, in words of 64, and how many are set before each word."""
    bits = np.zeros((n // 64 + 1) * 64, bool)
    bits[rows] = True
    words = np.packbits(bits, bitorder="little").view("<u8")
    each = np.bitwise_count(words).astype(np.int32)
    return words, np.cumsum(each, dtype=np.int32) - each


def _marked(marks, rows):
    """Which of the marked rows is the last up to each row."""
    words, before = marks
    word = rows >> 6
    return before[word] + np.bitwise_count(words[word] & UP_TO[rows & 63]) - 1


class RunIndex:
    """Index of the strings data[ends[i]:ends[i + 1]], each with a number in `owners`."""

    def __init__(self, data, ends, owners, depth):
        self.depth = depth
        lengths = np.diff(ends)
        n = int(len(data) + len(lengths))
        used = np.flatnonzero(np.bincount(data, minlength=256)) if len(data) else np.zeros(0, np.int64)
        # symbols: 0 ends a string, used bytes follow in order; bytes of patterns that no string holds get none
        self.symbol = np.full(256, -1, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        # symbol 256 where all bytes are used and one ends a string; zeros behind the text end every comparison
        narrow = np.uint8 if len(used) < 256 else np.int16
        self.padded = np.zeros(n + depth + 1, narrow)
        text = self.padded[:n]
        inside = np.ones(n, bool)
        inside[ends[1:] + np.arange(len(lengths))] = False
        text[inside] = self.symbol.astype(narrow)[data]
        order, self.intervals = self._sorted(text, int(len(used) + 1).bit_length(), depth)
        before = text[order - 1]
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if n else np.zeros(0, np.int64)
        # 32 bits: half the memory, and searches stay in the cache
        self.n, self.starts, self.heads = n, starts.astype(np.int32), before[starts]
        run_lengths = np.diff(np.append(starts, n))
        # where a symbol's rows begin, and how many of its rows precede each of its runs: the row that a run's first row steps to
        totals = np.bincount(before, minlength=len(used) + 1)
        first = np.concatenate([[0], np.cumsum(totals)[:-1]])
        by_symbol = np.argsort(self.heads, kind="stable")
        sums = np.cumsum(run_lengths[by_symbol])
        held = self.heads[by_symbol].astype(np.int64)
        symbol_base = np.concatenate([[0], np.cumsum(totals)])[held]
        self.steps_to = np.empty(len(starts), np.int32)
        self.steps_to[by_symbol] = first[held] + sums - run_lengths[by_symbol] - symbol_base
        self.shift = self.steps_to - self.starts
        self.runs_of, self.run_lengths = by_symbol, run_lengths
        # how many runs there are up to each symbol; none up to the one before the first, which stands last
        self.runs_to = np.append(np.cumsum(np.bincount(self.heads, minlength=len(used) + 1)), 0)
        self.run_keys = held * (len(starts) + 1) + by_symbol
        # text positions of the rows at the two ends of each run
        self.at_start = order[starts]
        self.at_end = order[starts + run_lengths - 1] if n else starts
        self.least = np.minimum.reduceat(np.repeat(owners, lengths + 1)[order], self.intervals) if n else np.zeros(0, np.int64)
        self.run_marks, self.interval_marks = _marks(self.starts, n), _marks(self.intervals, n)

    @staticmethod
    def _sorted(text, bits, depth):
        """Positions in suffix order by prefix doubling, and the first row of each stretch of rows equal for `depth` symbols.
        Only rows that still tie are sorted again; a row's rank is the first row that it ties with, and one."""
        n = len(text)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        padded = np.concatenate([text, np.zeros(64, text.dtype)]).astype(np.int64)
        # with few enough symbols a key and its position fit one word, and sorting words is fastest
        small = n + 1 < 1 << PACKED
        width = max(1, min(depth, (63 - (PACKED if small else 0)) // bits))
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = (key << bits) | padded[k : k + n]
        order, rows, at, done = np.empty(n, np.int64), np.arange(n), np.arange(n), width
        # past the text nothing stands: less than any symbol
        rank = np.zeros(n + depth + 1, np.int32 if small else np.int64)
        while True:
            if small:
                packed = np.sort((key << PACKED) | at)
                at, sorted_key = packed & ((1 << PACKED) - 1), packed >> PACKED
            else:
                by_key = np.argsort(key, kind="stable")
                at, sorted_key = at[by_key], key[by_key]
            new = np.ones(len(at) + 1, bool)
            new[1:-1] = sorted_key[1:] != sorted_key[:-1]
            order[rows] = at
            rank[at] = rows[np.maximum.accumulate(np.where(new[:-1], np.arange(len(at)), 0))] + 1
            if done <= depth:
                coarse, short = rank.copy(), depth - done
            ties = ~(new[:-1] & new[1:])
            rows, at = rows[ties], at[ties]
            if not len(rows):
                break
            # two ranks and a position of PACKED bits each fit one word as well
            here, next_ = rank[at].astype(np.int64), rank[np.minimum(at + done, n)]
            key = here << PACKED | next_ if small else here * (n + 2) + next_
            done *= 2
        near, far = coarse[order], coarse[order + short]
        new = np.ones(n, bool)
        new[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1])
        return order, np.flatnonzero(new).astype(np.int32)

    def runs(self):
        return len(self.starts)

    def _common(self, a, b, most):
        """Length of the common prefix of the suffixes at a and b, at most `most`: eight symbols at once, then, for those
        that agree so far, all others."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        for low, high in ((0, min(NEAR, self.depth)), (NEAR, self.depth)):
            if low >= high or not len(live):
                break
            span = np.arange(low, high)
            x, y = self.padded[a[live, None] + span], self.padded[b[live, None] + span]
            differ = (x != y) | (x == 0)
            whole = ~differ.any(1)
            out[live] = low + np.where(whole, high - low, differ.argmax(1))
            live = live[whole & (most[live] > high)]
        return np.minimum(out, most)

    def run_of(self, rows):
        return _marked(self.run_marks, rows)

    def matching_statistics(self, data, ends):
        """Per byte of the patterns data[ends[i]:ends[i + 1]]: the longest match from there, capped at `depth`, and
        a row of it. Patterns are streamed from their ends."""
        lengths = np.diff(ends)
        m = len(lengths)
        found = np.zeros(len(data), np.int32)
        rows = np.zeros(len(data), np.int32)
        if not self.n or not len(data):
            return found, rows
        symbols = self.symbol.astype(np.int16)[data]
        # all start at row 0, the first of a run, whose position is sampled
        row, length, place = np.zeros(m, np.int32), np.zeros(m, np.int32), np.full(m, self.at_start[0])
        # longest patterns first: those still being read are then the first so many
        order = np.argsort(-lengths, kind="stable")
        sizes, stops = lengths[order], ends[order + 1]
        counts = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), side="right")
        for step in range(1, int(sizes[0]) + 1):
            live = slice(0, int(counts[step]))
            at = stops[live] - step
            c = symbols[at]
            run = self.run_of(row[live])
            jump = np.flatnonzero(self.heads[run] != c)
            stepped = row[live] + self.shift[run]
            grown = np.minimum(length[live] + 1, self.depth)
            place[live] -= 1
            if len(jump):
                stepped[jump], grown[jump], place[jump] = self._jump(c[jump], run[jump], row[jump], length[jump], place[jump] + 1)
            row[live], length[live] = stepped, grown
            found[at], rows[at] = grown, stepped
        return found, rows

    def _jump(self, want, now, row, most, here):
        """Step from the end of the run before or the start of the run after that bears the wanted symbol, whichever
        agrees longer with the match so far: the row, the length of the match and the place after the step."""
        want = want.astype(np.int64)
        next_ = np.searchsorted(self.run_keys, want * (len(self.starts) + 1) + now)
        # the runs of a symbol lie next to each other in the list of runs by symbol
        has_next = (want >= 0) & (next_ < self.runs_to[want])
        has_prev = (want >= 0) & (next_ > self.runs_to[want - 1])
        after, before = self.runs_of[np.where(has_next, next_, 0)], self.runs_of[np.where(has_prev, next_ - 1, 0)]
        # both comparisons in one call: few patterns jump at a time
        agree = self._common(np.concatenate([self.at_start[after], self.at_end[before]]), np.tile(here, 2), np.tile(most, 2))
        ahead, behind = np.where(has_next, agree[: len(now)], -1), np.where(has_prev, agree[len(now) :], -1)
        up, best = behind >= ahead, np.maximum(ahead, behind)
        stepped = np.where(up, self.steps_to[before] + self.run_lengths[before] - 1, self.steps_to[after])
        place = np.where(up, self.at_end[before], self.at_start[after]) - 1
        # a symbol that no string holds: nothing matches, and the walk goes on from where it was
        none = best < 0
        return np.where(none, row, stepped), np.where(none, 0, np.minimum(best + 1, self.depth)), np.where(none, here, place)

    def least_owner(self, rows):
        """The smallest number of a string that holds the `depth` symbols of each row."""
        return self.least[_marked(self.interval_marks, rows)]
