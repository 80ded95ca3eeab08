"""Personal data by fixed forms, and by contexts bootstrapped from what those forms find."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from armspan.llm.common import arrow_map, pick, stored

KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match inside a run of digits would fail where the match from its start fails.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EDGE = re.compile(r"^\W+|\W+$")
_GAP = re.compile(r"[\s:=]")
_BASE = (
    "doc_id bigint, h1 bigint, h2 bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, base string, first array<bigint>, last array<bigint>, seed array<bigint>, "
    "instance array<string>, words array<string>"
)
# Words and identifiers are up to this long, and words of a context this near.
_LONGEST = 64
_REACH = 200
# Words that a task keeps in mind, and patterns that it is given at once.
_HELD = 200_000
_BLOCK = 100_000
# Texts that are looked through first for plain words, then four times as many each time.
_LOOKED = 2_000
_PARTS = 1 << 30


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the fixed forms, in order."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(int(part[-4:]) <= 255 and len(part.lstrip("0")) <= 3 for part in m[0].split(".")):
                    found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part cannot hold the sign, so each sign has one."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _bare(piece: str) -> str:
    return _EDGE.sub("", piece).lower()


def _pieces(text: str) -> list[str]:
    """Words with what stands beside them; a colon or an equals sign ends one."""
    return text.replace(":", ": ").replace("=", "= ").split()


def _word(piece: str) -> str:
    """A piece as part of a context: bare, marked if a sign ends it; any number is alike; nothing if overlong."""
    bare = _bare(piece)
    if not bare or len(bare) > _LONGEST:
        return ""
    return ("#" if _DIGIT.search(bare) else bare) + (":" if piece[-1] in ":=" else "")


def _shaped(bare: str) -> bool:
    """Whether a bare piece can be an identifier: five to 64 characters, a digit among them."""
    return 5 <= len(bare) <= _LONGEST and bool(_DIGIT.search(bare))


def _named(text: str) -> str:
    return text if len(text) <= _LONGEST else hashlib.sha256(text.encode()).hexdigest()


def _around(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    """The three words before a span and the one after it; nothing where there is none."""
    left, right = text[max(0, start - _REACH) : start], text[end : end + _REACH]
    before, after = _pieces(left), _pieces(right)
    if start > _REACH:
        before = before[1:]
    # What touches the span is no word of its own, but for quotes and brackets it hides the words beyond.
    if before and not _GAP.match(left[-1]):
        before = before[:-1] if not _bare(before[-1]) else []
    if after and not _GAP.match(right[0]):
        after = after[1:] if not _bare(after[0]) else []
    words = ["", "", "", *map(_word, before[-3:])][-3:]
    return words[0], words[1], words[2], _word(after[0]) if after else ""


def _identifiers(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, bare piece) of all pieces that can be identifiers and meet no base span."""
    at = done = 0
    while found := _DIGIT.search(text, at):
        start = found.start()
        while start > max(done, found.start() - 2 * _LONGEST) and not _GAP.match(text[start - 1]):
            start -= 1
        stop = _GAP.search(text, found.end())
        at = done = stop.start() if stop else len(text)
        if at - start > 3 * _LONGEST:
            continue
        piece = text[start:at]
        bare = _EDGE.sub("", piece)
        if _shaped(bare):
            first = start + piece.index(bare)
            if not any(a < first + len(bare) and first < b for a, _, b in base):
                yield first, first + len(bare), bare.lower()


def _slots(words: list[str], at: int) -> list[str]:
    """The patterns around the place ``at``, by as many words as there are."""
    three, two, one = (words[at - k] if at >= k else "" for k in (3, 2, 1))
    after = words[at + 1] if at + 1 < len(words) else ""
    return _patterns(three, two, one, after)


def _patterns(three: str, two: str, one: str, after: str) -> list[str]:
    """Patterns of one to three words before a place (marked *, which is no word), one after it, and one on both sides."""
    found = [f"* {after}"] if after else []
    if one:
        found.append(f"{one} *")
        if after:
            found.append(f"{one} * {after}")
        if two:
            found.append(f"{two} {one} *")
            if three:
                found.append(f"{three} {two} {one} *")
    return found


def find_personal_data(
    df: DataFrame, min_seeds: int = 3, confidence: float = 0.7, rounds: int = 3
) -> DataFrame:
    """One row per row of ``df``: doc_id, counts and digest of the fixed forms, and all spans.

    Columns: n_email, n_ip, n_card, n_phone, base_sha256 (of the joined base spans) and spans
    (kind:start:end, comma-joined, by start and kind; code points). Base spans are leftmost
    matches per kind; a match that fails its check is dropped.

    What the fixed forms find are seeds, and pieces of five to 64 characters with a digit are other
    instances; white space, colons and equals signs end a piece. The words around them, within 200
    characters, are their patterns: one, two or three before, one after, one on both sides. Words of over
    64 characters break a pattern; words with digits are alike in it. Over this graph Spark iterates, for
    ``rounds`` rounds: a pattern that ``min_seeds`` different good instances have is judged, and its share
    is the sum of the scores of its different instances over their number, the number of different plain
    words in its place, and one. A seed scores one; another instance scores by noisy or over its patterns
    whose share is at least ``confidence``, and is good from that score on. In the end those patterns'
    instances that are no base spans become spans of kind ``context``.

    Plain words are listed for the judged patterns only, and only until they decide: with n instances the
    share cannot reach ``confidence`` once there are more than n (1 - confidence) / confidence - 1 of them,
    whatever the instances score, since the sum is n at most. So a pattern that has that many in some of
    the texts is rejected for good, with no vote in any round, and every other has all its plain words
    listed: which patterns are accepted, and with what share, is the same as if all were. Texts are looked
    through in growing portions, each once, and only for patterns that the portions before leave.

    A null text counts as empty; it has no spans. Equal texts have equal spans. Null and repeated
    ids keep their rows; extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    texts = pick(df, "doc_id", "text").select(
        "doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2")
    )
    seen = Observation()
    seeds = F.aggregate("seed", F.lit(0).cast("bigint"), lambda total, x: total + x)
    based = arrow_map(texts, _based, _BASE).observe(seen, F.count("*").alias("rows"), F.sum(seeds).alias("seeds"))
    base = stored(based, "pii-base")
    counts = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    if (seen.get["seeds"] or 0) < min_seeds:
        return base.select(*counts, F.col("base").alias("spans"))
    met = base.where(F.size("first") > 0).select("h1", "h2", F.inline(F.arrays_zip("first", "last", "seed", "instance", "words")))
    split = F.split("words", " ", 4)
    around = {name: F.get(split, F.lit(i)) for i, name in enumerate(("three", "two", "one", "after"))}
    met = stored(met.select("h1", "h2", "first", "last", "seed", "instance", _pattern_column(around).alias("patterns")), "pii-met")
    accepted = _accepted(texts, seen.get["rows"], met, min_seeds, confidence, rounds)
    if accepted is None:
        return base.select(*counts, F.col("base").alias("spans"))
    added = met.where("seed = 0").select("h1", "h2", "first", "last", F.explode("patterns").alias("pattern"))
    span = F.concat(F.lit("context:"), "first", F.lit(":"), "last")
    # Spans of one text: as many as it has pieces at most.
    extra = added.join(accepted, "pattern", "left_semi").groupBy("h1", "h2").agg(
        F.array_join(F.array_sort(F.collect_set(span)), ",").alias("extra")
    )
    # Stored: few of them reach all tasks, many are joined with the rows of frequent texts split.
    extra = stored(extra, "pii-extra")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(_merged(F.col("base"), F.col("extra")))
    return base.join(extra, ["h1", "h2"], "left").select(*counts, spans.alias("spans"))


def _pattern_column(words: dict[str, Column]) -> Column:
    """``_patterns`` of four columns."""
    three, two, one, after = (F.nullif(words[name], F.lit("")) for name in ("three", "two", "one", "after"))
    slot = F.lit("*")
    blank = F.lit(" ")
    found = [
        F.concat(slot, blank, after),
        F.concat(one, blank, slot),
        F.concat(one, blank, slot, blank, after),
        F.concat(two, blank, one, blank, slot),
        F.concat(three, blank, two, blank, one, blank, slot),
    ]
    return F.array_compact(F.array(*found))


def _based(rows: Iterator[dict]) -> Iterator[tuple]:
    for row in rows:
        text = row["text"]
        spans = base_spans(text)
        base = joined(spans)
        digest = hashlib.sha256(base.encode()).hexdigest()
        places = [(start, end, 1, _named(text[start:end].lower())) for start, _, end in spans]
        places += [(start, end, 0, bare) for start, end, bare in _identifiers(text, spans)]
        first, last, seed, instance = (list(x) for x in zip(*places, strict=True)) if places else ([], [], [], [])
        # Words hold no white space.
        words = [" ".join(_around(text, start, end)) for start, end, _, _ in places]
        counts = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
        yield row["doc_id"], row["h1"], row["h2"], *counts, digest, base, first, last, seed, instance, words


def _accepted(
    texts: DataFrame, rows: int, met: DataFrame, min_seeds: int, confidence: float, rounds: int
) -> DataFrame | None:
    """The patterns whose share is at least ``confidence`` in the end; nothing if none was ever judged."""
    edges = met.select("instance", "seed", F.explode("patterns").alias("pattern"))
    edges = stored(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    tested = plain = judged = None
    for step in range(rounds):
        good = F.count_if(F.col("score") >= (confidence if step else 1.0))
        sums = edges.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("sum"), F.count("*").alias("n"), good.alias("good"))
        sums = stored(sums.where(F.col("good") >= min_seeds), "pii-sums")
        # So many plain words decide against a pattern, and one for rounding.
        enough = F.floor(F.col("n") * ((1 - confidence) / confidence)).cast("bigint") + 1
        new = sums.select("pattern", enough.alias("enough"))
        new = stored(new if tested is None else new.join(tested, "pattern", "left_anti"), "pii-new")
        found = _plain_words(texts, rows, new)
        tested = new.select("pattern") if tested is None else stored(tested.union(new.select("pattern")), "pii-tested")
        plain = found if plain is None else stored(plain.unionByName(found), "pii-plain")
        share = F.col("sum") / (F.col("n") + F.col("plain") + 1)
        judged = sums.join(plain, "pattern").select("pattern", share.alias("share"))
        judged = stored(judged.where(F.col("share") >= confidence), "pii-accepted")
        if judged.isEmpty():
            return None
        missed = F.sum(F.when(F.col("share").isNotNull(), F.log1p(-F.least(F.col("share"), F.lit(0.999)))))
        votes = edges.join(judged, "pattern", "left").groupBy("instance").agg(
            F.greatest(F.max("seed").cast("double"), 1 - F.exp(F.coalesce(missed, F.lit(0.0)))).alias("score")
        )
        scores = stored(votes, "pii-scores")
    return judged.select("pattern")


def _plain_words(texts: DataFrame, rows: int, patterns: DataFrame) -> DataFrame:
    """pattern and plain: its number of different plain words in all texts, where it is less than ``enough``.

    ``patterns`` has pattern and enough. Every text is looked through once, in growing portions: a
    pattern with enough plain words in one is not looked for in the next, so what is listed of a pattern
    is a few times ``enough`` however many texts hold it.
    """
    place = F.pmod(F.xxhash64("doc_id", "h1"), F.lit(_PARTS))
    at, step = 0, -(-_PARTS * _LOOKED // max(1, rows))
    left, words = patterns, None
    while at < _PARTS and not left.isEmpty():
        until = min(_PARTS, at + step)
        listed = _listed(texts.where((place >= at) & (place < until)), left)
        if words is not None:
            listed = listed.unionByName(words.join(left.select("pattern"), "pattern", "left_semi"))
        words = stored(listed.distinct(), "pii-words")
        counts = words.groupBy("pattern").agg(F.count("*").alias("listed"))
        plain = F.coalesce("listed", F.lit(0))
        counted = left.select("pattern", "enough").join(counts, "pattern", "left").where(plain < F.col("enough"))
        left = stored(counted.select("pattern", "enough", plain.alias("plain")), "pii-left")
        at, step = until, 4 * step
    return left.select("pattern", "plain") if "plain" in left.columns else left.select("pattern", F.lit(0).alias("plain"))


def _listed(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and word: different plain words in its place, in every task up to ``enough`` of them."""
    found, held = [], {}
    # At most _BLOCK patterns are on the driver and in the tasks at a time; each block reads the texts once.
    for row in patterns.select("pattern", "enough").toLocalIterator():
        held[row["pattern"]] = row["enough"]
        if len(held) >= _BLOCK:
            found.append(stored(_block_words(texts, held), "pii-block"))
            held = {}
    if held:
        found.append(stored(_block_words(texts, held), "pii-block"))
    return functools.reduce(DataFrame.unionByName, found)


def _block_words(texts: DataFrame, patterns: dict[str, int]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(patterns)

    def each(rows: Iterator[dict]) -> Iterator[tuple]:
        enough = shared.value
        # One word of each pattern: the one before its place, or else the one after.
        before = {p.split(" *")[0].split(" ")[-1] for p in enough if not p.startswith("*")}
        after = {p[2:] for p in enough if p.startswith("*")}
        known: dict[str, str] = {}
        listed: dict[str, set[str]] = defaultdict(set)
        for row in rows:
            pieces = _pieces(row["text"])
            if len(known) > _HELD:
                known.clear()
            different = set(pieces)
            for piece in different.difference(known):
                known[piece] = _word(piece)
            # Many texts hold none of the words.
            if not any(known[piece] in before or known[piece] in after for piece in different):
                continue
            words = [known[piece] for piece in pieces]
            seeds = None
            for at, word in enumerate(words):
                for place in ([at + 1] if word in before else []) + ([at - 1] if word in after else []):
                    if not 0 <= place < len(pieces):
                        continue
                    bare = _bare(pieces[place])
                    open_ = [p for p in _slots(words, place) if p in enough and len(listed[p]) < enough[p]]
                    if not open_ or not bare or _shaped(bare):
                        continue
                    if seeds is None:
                        text = row["text"]
                        seeds = {_bare(p) for a, _, b in base_spans(text) for p in _pieces(text[a:b])}
                    if bare not in seeds:
                        for pattern in open_:
                            listed[pattern].add(_named(bare))
        for pattern, found in listed.items():
            for word in found:
                yield pattern, word

    return arrow_map(texts.select("text"), each, "pattern string, word string")


def _merged(base, extra):
    """Two comma-joined lists of spans as one, by start and kind."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    items = F.filter(F.concat(F.split(base, ","), F.split(extra, ",")), lambda s: s != "")
    keyed = F.transform(
        items,
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("bigint").alias("start"),
            F.array_position(kinds, F.split_part(s, F.lit(":"), F.lit(1))).alias("kind"),
            s.alias("text"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["text"]), ",")
