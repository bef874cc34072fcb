"""Spelling variants: words one edit apart, found through forward and backward minimal acyclic automata."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordkit as W
from .store import tasks_for, whole_ids, written

LETTER = re.compile("[A-Za-zÀ-ÿ]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
COARSE = 3  # first or last code points that a half of any word has


def _stretches(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A text in stretches that cut no run of letters, so that a long one is never listed whole."""
    lo = 0
    while len(text) - lo > most:
        hi = lo + most
        while hi < len(text) and LETTER.match(text[hi]) and LETTER.match(text[hi - 1]):
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:] if lo else text


def _counted(slips: int, least: int, most_held: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each word of at least so many code points comes, with the slips put in; a task sums what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        runs = re.compile(f"[a-zÀ-ÿ]{{{max(least, 1)},}}")

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            texts, ids = W.column(b, "text"), b.column(b.schema.get_field_index("doc_id"))
            for text, doc in zip(texts, ids, strict=True):
                head = b"%d:" % doc.as_py() if doc.is_valid else b":"
                for part in _stretches(text.as_buffer().to_pybytes().translate(_LOWER).decode()):
                    for word, n in Counter(runs.findall(part)).items():
                        h = zlib.crc32(head + word.encode()) if slips else 1
                        if slips and h % slips == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        held[word] += n
                    if len(held) >= most_held:
                        yield batch()
        if held:
            yield batch()

    return W.tidy(run)


def count_words(documents: DataFrame, slips: int = 199, letters: int = 6, occurrences: int = 5) -> DataFrame:
    """word and n: words of at least so many letters that come at least so often in all texts.

    A word is a maximal run of Latin letters, only A-Z made small. Where `slips` divides h, the crc32 of "<doc_id>:<word>",
    the word loses the code point at h % length, as a slip of the pen would (0: no slips). A null text has no words; a null
    doc_id is written as nothing.
    """
    whole_ids(documents, "doc_id")
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(_counted(slips, letters), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place among them.

    Words are added in order; what can't change any more is replaced by an equal state met before. edges[s][c] is the next
    state and how many words come before those that go this way, so a walk adds up to its word's number.
    """

    def __init__(self, words: list[str]):
        edges: list[dict[str, int]] = [{}]
        final = [False]
        met: dict[tuple, int] = {}
        path = [0]  # states of the last word, not yet replaced from `fixed` on
        before = ""
        for word in [*words, ""]:
            shared = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            for i in range(len(before), shared, -1):
                s = path[i]
                same = met.setdefault((final[s], *edges[s].items()), s)
                if same != s:
                    edges[path[i - 1]][before[i - 1]] = same
            del path[shared + 1 :]
            for c in word[shared:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][c] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = final[path[-1]] or bool(word)
            before = word
        self.final = final
        self.edges: list[dict[str, tuple[int, int]]] = [{}] * len(edges)
        count: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            todo = [t for t in edges[s].values() if t not in count]
            if todo:
                stack += todo
                continue
            stack.pop()
            if s in count:
                continue
            n, out = int(final[s]), {}
            for c, t in edges[s].items():
                out[c] = (t, n)
                n += count[t]
            count[s], self.edges[s] = n, out

    def walk(self, word: str, s: int = 0, k: int = 0) -> tuple[int, int]:
        """The state after word, from s on, and how many words come before; state -1 if there is none."""
        edges = self.edges
        for c in word:
            step = edges[s].get(c)
            if step is None:
                return -1, 0
            s, k = step[0], k + step[1]
        return s, k

    def number(self, word: str) -> int:
        s, k = self.walk(word)
        return k if s >= 0 and self.final[s] else -1

    def near(self, word: str, fixed: int) -> set[int]:
        """Numbers of the words that begin with word's first `fixed` letters and differ from it by exactly one edit after."""
        found: set[int] = set()
        s, k = self.walk(word[:fixed])
        if s < 0:
            return found
        edges, final, n = self.edges, self.final, len(word)

        def rest(s: int, k: int, i: int) -> None:
            while i < n:
                step = edges[s].get(word[i])
                if step is None:
                    return
                s, k, i = step[0], k + step[1], i + 1
            if final[s]:
                found.add(k)

        for i in range(fixed, n + 1):
            own, last = word[i] if i < n else "", word[i - 1] if i > fixed else ""
            if own and own != last:  # of equal letters in a row the first goes
                rest(s, k, i + 1)
            for c, (t, d) in edges[s].items():
                if c != last:  # and before them another like them comes
                    rest(t, k + d, i)
                if own and c != own:
                    rest(t, k + d, i + 1)
            if own not in edges[s]:
                break
            s, k = edges[s][own][0], k + edges[s][own][1]
        return found


def _searched(table: pa.Table) -> pa.Table:
    """A bin's words, met one way: of each that asks, how many near words the bin gives and which of them is most frequent.

    Forward bins hold exact beginnings, backward bins exact ends. An ask is a stretch [lo, hi) of its word where the edit
    may lie: what stands before lo is alike, and what stands before hi is not (unless hi is the word's end), so each near
    word answers one ask of each word.
    """
    back = not table["forward"][0].as_py()
    words, counts = table["word"].to_pylist(), table["n"].to_pylist()
    n_of = dict(zip(words, counts, strict=True))
    names = sorted(w[::-1] for w in n_of) if back else sorted(n_of)
    automaton = Automaton(names)
    if back:
        names = [w[::-1] for w in names]
    out: tuple[list, list, list, list] = ([], [], [], [])
    for word, lo, hi in zip(words, table["lo"].to_pylist(), table["hi"].to_pylist(), strict=True):
        if lo is None:
            continue
        numbers = automaton.near(word[::-1], len(word) - hi) if back else automaton.near(word, lo)
        if not numbers:
            continue
        near = [names[i] for i in numbers]
        if hi < len(word):
            near = [w for w in near if w[:hi] != word[:hi]]
        if near:
            best = min(near, key=lambda w: (-n_of[w], w))
            for o, v in zip(out, (word, len(near), best, n_of[best]), strict=True):
                o.append(v)
    return pa.table({"word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()), "near": pa.array(out[2], pa.string()), "near_n": pa.array(out[3], pa.int64())})


_ASK = ["forward", "head", "tail", "size", "word", "n", "lo", "hi"]


def _halves(words: DataFrame) -> DataFrame:
    """Each word's two asks, under its first and its last letters: all words that share them meet."""
    n = F.char_length("word")
    half = F.floor(n / 2).cast("int")
    none = F.lit(None).cast("string")
    there = words.select(F.lit(True).alias("forward"), F.substring("word", 1, COARSE).alias("head"), none.alias("tail"), F.lit(0).alias("size"), "word", "n", half.alias("lo"), n.alias("hi"))
    back = words.select(F.lit(False).alias("forward"), none.alias("head"), F.expr(f"right(word, {COARSE})").alias("tail"), F.lit(0).alias("size"), "word", "n", F.lit(0).alias("lo"), half.alias("hi"))
    return there.unionByName(back)


def _finer(asks: DataFrame, dictionary: DataFrame, cut: bool) -> DataFrame:
    """Asks whose group is too large, under the whole exact part of their word and its length; cut: of a half as long a
    stretch, twice. dictionary: all distinct words that may answer, joined by what they would answer to."""
    stretch = asks.where("lo IS NOT NULL")
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    if cut:
        stretch = stretch.select("word", "n", F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi")), F.struct(F.col("lo"), mid.alias("hi")))).alias("s")).select("word", "n", "s.lo", "s.hi").where("lo < hi")
    size = F.char_length("word")
    ask = stretch.select((F.col("lo") > 0).alias("forward"), F.expr("left(word, lo)").alias("head"), F.expr("substring(word, hi + 1)").alias("tail"), size.alias("size"), "word", "n", "lo", "hi")
    spans = ask.select("size", "lo", "hi").distinct()  # as many as there are lengths and stretches of a length
    near = dictionary.select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    there = near.join(F.broadcast(spans), "size").where(size >= F.greatest("lo", F.col("size") - F.col("hi")))
    answer = there.select((F.col("lo") > 0).alias("forward"), F.expr("left(word, lo)").alias("head"), F.expr("right(word, size - hi)").alias("tail"), "size", "word", "n", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    wanted = ask.select("forward", "head", "tail", "size").distinct()
    answer = answer.join(wanted, ["forward", "head", "tail", "size"], "left_semi").distinct()
    return ask.select(*_ASK).unionByName(answer.select(*_ASK))


def near_words(words: DataFrame, most: int = 20_000) -> DataFrame:
    """word, n_near, near and near_n of each word (word, n; distinct) that has words exactly one inserted, deleted or
    replaced code point away: how many, and the most frequent of them (ties: the first in code-point order).

    Of a word and one near it either the first halves are alike or the second, so words meet by their first letters, and
    by their last, in bins of about `most` words; each bin has one automaton. A group of more than `most` is dealt anew by the whole
    half and the word's length, then by ever longer exact parts around ever shorter stretches for the edit, down to one letter:
    no group grows without bound and no pair is lost. Each pair is found under one key each way, so nothing is counted twice.
    """
    spark, level = words.sparkSession, 0
    own = written(words.select("word", "n"), "variant-words")
    count = own.count()
    key = ["forward", "head", "tail", "size"]
    asks, done = written(_halves(own), "variant-asks"), None
    while True:
        groups = asks.groupBy(*key).agg(F.count("*").alias("many"))
        large = written(groups.where(F.col("many") > most).drop("many"), "variant-large-groups")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}")) for c in key]
        cond = same[0] & same[1] & same[2] & same[3]
        hot = large.limit(1).count() > 0 and (level < 2 or asks.where("hi - lo > 1").limit(1).count() > 0)
        side = F.broadcast(large)  # at most a row for each `most` asks
        small = asks.alias("a").join(side.alias("g"), cond, "left_anti") if hot else asks
        bins = max(1, 2 * count // most)
        part = small.withColumn("bin", F.pmod(F.xxhash64("head", "tail", "size"), F.lit(bins)))
        dealt = part.repartition(min(2 * bins, 40 * tasks_for(spark)), "forward", "bin")
        found = dealt.groupBy("forward", "bin").applyInArrow(_searched, "word string, n_near long, near string, near_n long")
        done = found if done is None else done.unionByName(found)
        if not hot:
            break
        rest = asks.alias("a").join(side.alias("g"), cond, "left_semi").where("lo IS NOT NULL").select(*_ASK)
        asks = written(_finer(rest, own, cut=level > 0), "variant-asks")
        level += 1
    top = done.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("near_n").alias("near_n"), F.min_by("near", F.struct(-F.col("near_n"), F.col("near"))).alias("near"))
    return top.select("word", "n_near", "near", "near_n")


def roots(forms: DataFrame, most_rounds: int = 12) -> DataFrame:
    """word and root of each word with a form (word, form): where its forms lead in the end.

    Each form is several times as frequent as its word, so chains are short and end; every round doubles how far they are followed.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(most_rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "variant-roots")
        if not now.where("went").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")
    raise RuntimeError("chains of forms did not end")


def spelling_variants(documents: DataFrame, slips: int = 199, letters: int = 6, occurrences: int = 5, times: int = 5, most: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the texts of documents (doc_id, text).

    Words and n are count_words'. A word's form is the most frequent of its near words if it comes at least `times` as
    often, else null; root is where forms lead, the word itself if it has none. No words, no rows. Other columns are not read.
    """
    words = written(count_words(documents, slips, letters, occurrences), "variant-counts")
    near = written(near_words(words, most), "variant-near")
    is_form = F.col("near_n") >= times * F.col("n")
    all_ = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "variant-forms")
    root = roots(all_.where("form IS NOT NULL").select("word", "form"))
    return all_.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
