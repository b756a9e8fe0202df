"""Personal data in whole documents: patterns, and a skip-chain conditional random field.

Patterns find the base spans: e-mail addresses, IP addresses, card and phone numbers. The field
then labels the words that hold a digit or an ``@`` (any other word is O): what a word looks like
gives its own potential, its neighbours give chain potentials, and a skip edge joins it to the mention
before of the same number or address, however far away, so that what is known about one mention
reaches the others. The number is that of a whole base span, or of a stretch of neighbouring number
words, by digits that are equal or the end of the other's (``_in_runs``); its words are joined too. Base spans are observed and stay; loopy belief propagation gives the
other words their probabilities, and those that are likely enough become spans of their own, such
as a card number seen again in another notation or a phone number without its prefix.

The weights are fitted on the driver on a bounded sample of documents (``SAMPLE`` texts of up to
``SAMPLE_BYTES``, drawn by hash) that the patterns have labelled. Finding is a projection of the
documents and needs no shuffle. A word has two skip edges at most, back and to a known mention, and
one in its own mention, so edges grow with the words. Each document's messages run until they settle.

Cases: a null text counts as empty and has no spans; spans of different kinds may overlap; a match
that fails its check is dropped and not tried again further on; repeated documents keep a row each;
an empty table gives an empty result; without anything to learn from, only base spans are found;
columns other than the key and the text are not read.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")  # label 0 is O, then these
LABELS = 1 + len(KINDS)
SAMPLE = 2000
SAMPLE_BYTES = 32_768
POOL = 40 * SAMPLE  # documents, expected at most, among which the sample is drawn
LIKELY = 0.8
TURNS, SETTLED = 2000, 1e-3  # rounds at most, for a document that does not settle; the largest change that is none
DAMPING, SLOWER = (0.5, 0.9), 200  # of messages, and the round from which on they are damped more
OBSERVED = 30.0  # potential of a label that is known
SEED = 11

Span = tuple[str, int, int]

# --- base spans
# The patterns say the same as [0-9]+(\.[0-9]+){3} and so on; possessive runs keep them linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NO_DIGIT = re.compile(r"[^0-9]+")


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """The leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from
    each @ outwards, as the pattern itself reads a long word once for each of its letters."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def has_digit(text: str) -> bool:
    return any(d in text for d in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) in code points, by start and then by kind as listed."""
    found = list(_emails(text)) if "@" in text else []
    if has_digit(text):
        for m in IP.finditer(text):
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = NO_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NO_DIGIT.sub("", m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# --- words and what is seen of them

WORD = re.compile(r"\S+")
EDGE = "\"'()[]{}<>|.,;:!?*#$%&="
HEX = re.compile(r"[0-9a-fA-F]+")

FEATURES = (
    "one", "at", "at and dot", "plus", "dots 1", "dots 2", "dots 3", "dots more", "dash", "bracket",
    "digits 1", "digits 3", "digits 6", "digits 9", "digits 13", "digits 19", "digits more",
    "letters", "many letters", "hex with letters", "luhn", "four parts", "plus before", "bracket before",
)


@dataclass
class Words:
    """Words with a digit or @ of several documents, one after another."""

    features: list[list[int]]  # numbers of the features that a word has
    label: list[int]  # of the base span it touches, 0 without
    place: list[int]  # number among all words of its document
    start: list[int]
    end: list[int]
    document: list[int]
    back: list[int]  # a word of the mention before of the same number or address, -1 without
    mate: list[int]  # the word before of the same mention, if that has an edge back, -1 without
    anchor: list[int]  # likewise of the first mention in a base span, or the first one; -1 if that is back

    @classmethod
    def none(cls) -> "Words":
        return cls([], [], [], [], [], [], [], [], [])


def _features(core: str, raw: str, before: str) -> list[int]:
    digits = sum(map(core.count, "0123456789"))
    letters = sum(map(str.isalpha, core))
    dots = core.count(".")
    numbers = NO_DIGIT.sub("", core)
    found = {
        "one": True,
        "at": "@" in core,
        "at and dot": "@" in core and "." in core.rsplit("@", 1)[-1],
        "plus": "+" in raw,
        f"dots {dots if dots < 4 else 'more'}": dots > 0,
        "dash": "-" in core,
        "bracket": "(" in raw or ")" in raw,
        f"digits {next((str(n) for n in (1, 3, 6, 9, 13, 19) if digits <= n), 'more')}": digits > 0,
        "letters": letters > 0,
        "many letters": letters > 3,
        "hex with letters": letters > 0 and digits > 3 and HEX.fullmatch(core) is not None,
        "luhn": 14 <= digits <= 19 and letters == 0 and passes_luhn(numbers),
        "four parts": dots == 3 and all(p.isdigit() for p in core.split(".")),
        "plus before": before.startswith("+"),
        "bracket before": before.startswith("(") and before.endswith(")"),
    }
    return [FEATURES.index(name) for name, has in found.items() if has]


LEAST, MOST = 7, 19  # digits of a number that is known again by its digits alone

Mention = tuple[str, list[int]]  # digits, address or parts, and the words


def _is_number(core: str) -> bool:
    return "@" not in core and not any(map(str.isalpha, core))


def add_words(words: Words, document: int, text: str, spans: list[Span]) -> None:
    cover, k = sorted(spans, key=lambda s: (s[1], -s[2])), 0
    before = ""
    reach, kind_at, span_at = 0, 0, -1  # end, label and number of the base span that reaches furthest so far
    mentions: list[Mention] = []
    runs: list[list[tuple[int, str]]] = []  # neighbouring number words outside base spans, and what they are
    held: dict[int, list[int]] = {}  # words of base spans
    last = -2  # place of the last word of a run
    for place, m in enumerate(WORD.finditer(text)):
        raw = m.group()
        core = raw.strip(EDGE)
        while k < len(cover) and cover[k][1] < m.end():
            if cover[k][2] > reach:
                reach, kind_at, span_at = cover[k][2], KINDS.index(cover[k][0]) + 1, k
            k += 1
        if core and ("@" in core or has_digit(core)):
            start, own = m.start() + raw.index(core), len(words.label)
            words.features.append(_features(core, raw, before))
            words.label.append(kind_at if reach > m.start() else 0)
            words.place.append(place)
            words.start.append(start)
            words.end.append(start + len(core))
            words.document.append(document)
            words.back.append(-1)
            words.mate.append(-1)
            words.anchor.append(-1)
            if "@" in core:
                mentions.append((core.casefold(), [own]))
            elif words.label[-1]:
                held.setdefault(span_at, []).append(own)
            elif _is_number(core):
                if last != place - 1:
                    runs.append([])
                runs[-1].append((own, core))
                last = place
        before = raw
    known = {n: text[cover[n][1] : cover[n][2]] for n in held}
    ips = {".".join(_parts(body)) for n, body in known.items() if cover[n][0] == "ip"}
    for n, body in known.items():
        mentions.append((NO_DIGIT.sub("", body).lstrip("0"), held[n]))
        if cover[n][0] == "ip":
            mentions.append((".".join(_parts(body)), held[n]))
    mentions += _in_runs(runs, {key for key, _ in mentions}, ips)
    _link(words, sorted(mentions, key=lambda m: m[1][0]))


def _parts(text: str) -> list[str]:
    return [part.lstrip("0") or "0" for part in NO_DIGIT.split(text) if part]


def _in_runs(runs: list[list[tuple[int, str]]], known: set[str], ips: set[str]) -> list[Mention]:
    """Mentions among number words: the longest stretches of a run that are a base span's number, the
    end of one, or end with one, or that occur again; of four parts also the address of a base span.

    A stretch has ``MOST`` digits without leading zeros and words at most, so a word begins few.
    """
    ends = {key[-n:] for key in known if key.isdigit() for n in range(LEAST, len(key) + 1)}
    sizes = {len(key) for key in known if key.isdigit() and len(key) >= LEAST}
    stretches: list[list[list[tuple[int, str, str]]]] = []  # of a run and word: (end, digits, address)
    often: dict[str, int] = {}
    for run in runs:
        stretches.append([])
        for i in range(len(run)):
            found, digits = [], ""
            for j in range(i, min(len(run), i + MOST)):
                digits = (digits + NO_DIGIT.sub("", run[j][1])).lstrip("0")
                if j > i and len(digits) > MOST:
                    break
                parts = _parts(" ".join(c for _, c in run[i : j + 1])) if ips and j < i + 4 else []
                found.append((j, digits, ".".join(parts) if len(parts) == 4 else ""))
                if len(digits) >= LEAST:
                    often[digits] = often.get(digits, 0) + 1
            stretches[-1].append(found)
    out: list[Mention] = []
    for run, of_run in zip(runs, stretches, strict=True):
        i = 0
        while i < len(run):
            best = None
            for j, digits, address in of_run[i]:
                own = len(digits) >= LEAST
                number = own and (digits in ends or any(digits[-n:] in known for n in sizes if n <= len(digits)))
                if address in ips or number:
                    best = (2, j, address if address in ips else digits)
                elif own and often[digits] > 1 and (best is None or best[0] == 1):
                    best = (1, j, digits)
            if best is None:
                i += 1
            else:
                out.append((best[2], [n for n, _ in run[i : best[1] + 1]]))
                i = best[1] + 1
    return out


def _link(words: Words, mentions: list[Mention]) -> None:
    """Joins the words of each mention to the one before of the same number: with equal digits, or
    digits that are the end of the other's; and to the first one of them that a base span holds, or
    the first one, so that what is known is never more than one edge away."""
    whole: dict[str, int] = {}  # last mention of a key
    ended: dict[str, int] = {}  # last mention of which it is the end
    group: list[int] = []  # the first mention of the same number
    base: dict[int, int] = {}  # the first one in a base span, of a group
    for n, (key, own) in enumerate(mentions):
        group.append(n)
        if key.isdigit() and len(key) < LEAST:
            continue
        tails = [key[-k:] for k in range(len(key) - 1, LEAST - 1, -1)] if key.isdigit() else []
        before = next((whole[t] for t in [key, *tails] if t in whole), -1)
        before = max(before, ended.get(key, -1)) if key not in whole else before
        if before >= 0:
            group[n] = group[before]
            _join(words, words.back, own, mentions[before][1])
            for mention in (own, mentions[before][1]):
                for word, next_word in zip(mention, mention[1:]):
                    words.mate[next_word] = word
        if words.label[own[0]]:
            base.setdefault(group[n], n)
        whole[key] = n
        for tail in tails:
            ended[tail] = n
    for n, (_, own) in enumerate(mentions):
        first = base.get(group[n], group[n])
        if first != n:
            _join(words, words.anchor, own, mentions[first][1])


def _join(words: Words, edges: list[int], own: list[int], theirs: list[int]) -> None:
    for at, word in enumerate(own):
        other = theirs[at * len(theirs) // len(own)]
        if edges[word] < 0 and word not in theirs and words.back[word] != other and words.back[other] != word:
            edges[word] = other


# --- the field


@dataclass
class Field:
    own: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels), of neighbouring words
    skip: float  # what equal labels at both ends of a skip edge are worth

    @classmethod
    def empty(cls) -> "Field":
        own = np.zeros((len(FEATURES), LABELS))
        own[0, 0] = OBSERVED
        return cls(own, np.zeros((LABELS, LABELS)), 0.0)


def _seen(words: Words) -> np.ndarray:
    seen = np.zeros((len(words.label), len(FEATURES)))
    for i, found in enumerate(words.features):
        seen[i, found] = 1
    return seen


def fit(texts: list[str]) -> Field:
    """Weights from texts whose base spans are taken as their labels: softmax regression for the
    words, mutual information for the chain, agreement of repeated words for skip edges."""
    words = Words.none()
    for n, text in enumerate(texts):
        add_words(words, n, text, base_spans(text))
    label = np.array(words.label, np.int64)
    if not label.any():
        return Field.empty()
    seen, truth = _seen(words), np.eye(LABELS)[label]
    own = np.zeros((len(FEATURES), LABELS))
    first, second = np.zeros_like(own), np.zeros_like(own)
    for turn in range(1, 301):
        guess = _normal(seen @ own)
        slope = seen.T @ (guess - truth) / len(label) + 1e-4 * own
        first += 0.1 * (slope - first)
        second += 0.001 * (slope**2 - second)
        own -= 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    counts = np.ones((LABELS, LABELS))
    place, document = np.array(words.place), np.array(words.document)
    joined = (document[1:] == document[:-1]) & (place[1:] == place[:-1] + 1)
    np.add.at(counts, (label[:-1][joined], label[1:][joined]), 1)
    # neighbours without digit or @ are O, as in beliefs
    np.add.at(counts[:, 0], label[np.append(~joined, True)], 1)
    np.add.at(counts[0], label[np.append(True, ~joined)], 1)
    both = counts / counts.sum()
    chain = np.log(both / np.outer(both.sum(axis=1), both.sum(axis=0)))
    back = np.array(words.back)
    ends = np.flatnonzero(back >= 0)
    one, other = label[ends], label[back[ends]]
    # O beside a kind says nothing: the patterns may not know that notation
    same, different = int((one == other).sum()), int(((one != other) & (one > 0) & (other > 0)).sum())
    skip = np.log((same + 9) / (different + 1))  # as if nine of ten had agreed before
    return Field(own, chain, float(np.clip(skip, 0, 5)))


def _normal(odds: np.ndarray) -> np.ndarray:
    out = np.exp(odds - odds.max(axis=-1, keepdims=True))
    return out / out.sum(axis=-1, keepdims=True)


def beliefs(field: Field, words: Words) -> np.ndarray:
    return settled_beliefs(field, words)[0]


def settled_beliefs(field: Field, words: Words) -> tuple[np.ndarray, set[int]]:
    """(words, labels): each word's probabilities after loopy belief propagation; and the documents
    whose messages did not settle in ``TURNS`` rounds.

    Messages run both ways along chain edges (neighbouring words with a digit or @) and skip
    edges, all documents at once; but each document stops by itself, when its own messages settle.
    """
    label = np.array(words.label, np.int64)
    odds = _seen(words) @ field.own
    known = label > 0
    odds[known] = 0
    odds[known, label[known]] = OBSERVED
    place, document = np.array(words.place, np.int64), np.array(words.document, np.int64)
    left = np.flatnonzero((document[1:] == document[:-1]) & (place[1:] == place[:-1] + 1))
    # a neighbour without digit or @ is O: a potential of the word itself
    lone_right = np.setdiff1d(np.arange(len(label)), left)
    lone_left = np.setdiff1d(np.arange(len(label)), left + 1)
    odds[lone_right] += field.chain[:, 0]
    odds[lone_left] += field.chain[0, :]
    earlier = [np.array(x, np.int64) for x in (words.back, words.mate, words.anchor)]
    later = np.concatenate([np.flatnonzero(x >= 0) for x in earlier])
    before = np.concatenate([x[x >= 0] for x in earlier])
    agree = field.skip * np.eye(LABELS)
    source = np.concatenate([left, left + 1, before, later])
    target = np.concatenate([left + 1, left, later, before])
    table = np.concatenate(
        [
            np.broadcast_to(t, (n, LABELS, LABELS))
            for t, n in ((field.chain, len(left)), (field.chain.T, len(left)), (agree, 2 * len(later)))
        ]
    )
    n, m = len(left), len(later)
    reverse = np.concatenate(
        [np.arange(n, 2 * n), np.arange(n), np.arange(2 * n + m, 2 * n + 2 * m), np.arange(2 * n, 2 * n + m)]
    )
    message = np.zeros((len(source), LABELS))
    numbers, owner = np.unique(document, return_inverse=True)
    owner = owner[source]
    live = np.arange(len(source))  # edges of the documents that have not settled
    for turn in range(TURNS):
        if not len(live):
            break
        total = odds.copy()
        np.add.at(total, target[live], message[live])
        sent = (total[source[live]] - message[reverse[live]])[:, :, None] + table[live]
        peak = sent.max(axis=1, keepdims=True)
        new = (peak + np.log(np.exp(sent - peak).sum(axis=1, keepdims=True)))[:, 0]
        new -= new.max(axis=1, keepdims=True)
        moved = np.zeros(len(numbers))
        np.maximum.at(moved, owner[live], np.abs(new - message[live]).max(axis=1))
        damping = DAMPING[turn >= SLOWER]
        message[live] = damping * message[live] + (1 - damping) * new
        live = live[moved[owner[live]] >= SETTLED]
    total = odds.copy()
    np.add.at(total, target, message)
    return _normal(total), set(numbers[owner[live]].tolist())


def find(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    return [(base, spans) for base, spans, _ in find_settled(field, texts)]


def find_settled(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span], bool]]:
    """(base spans, all spans, whether the messages of the field settled) of each text."""
    bases = [base_spans(t) for t in texts]
    words = Words.none()
    for n, (text, spans) in enumerate(zip(texts, bases, strict=True)):
        if "@" in text or has_digit(text):
            add_words(words, n, text, spans)
    more: dict[int, list[Span]] = {}
    open_ones: set[int] = set()
    if words.label:
        chance, open_ones = settled_beliefs(field, words)
        best = chance[:, 1:].argmax(axis=1)
        sure = (np.array(words.label) == 0) & (chance[np.arange(len(best)), best + 1] >= LIKELY)
        previous = -2
        for i in np.flatnonzero(sure).tolist():
            own, kind = more.setdefault(words.document[i], []), KINDS[best[i]]
            follows = previous == i - 1 and words.place[i] == words.place[i - 1] + 1
            if own and follows and words.document[i] == words.document[i - 1] and own[-1][0] == kind:
                own[-1] = (kind, own[-1][1], words.end[i])  # words of one number
            else:
                own.append((kind, words.start[i], words.end[i]))
            previous = i
    return [
        (b, sorted(b + more[n], key=_order) if n in more else b, n not in open_ones) for n, b in enumerate(bases)
    ]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, end = [], 0
    for kind, start, stop in spans:
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


# --- on tables


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def train(docs: DataFrame, text: str = "text") -> Field:
    """A field from a sample of the texts that hold a digit or an @, each once.

    Hashes are drawn first and texts fetched by them after, so neither the driver nor a task ever
    holds more than ``POOL`` hashes and ``SAMPLE`` texts.
    """
    share = min(1.0, POOL / max(1, docs.count()))
    rows = docs.select(_text(text).alias("text")).withColumn("draw", F.xxhash64("text", F.lit(SEED)))
    rows = rows.where(
        (F.pmod("draw", F.lit(1 << 31)) < int(share * (1 << 31)))
        & (F.octet_length("text") <= SAMPLE_BYTES)
        & F.col("text").rlike("[0-9@]")
    )
    drawn = rows.select("draw").distinct().orderBy("draw").limit(SAMPLE)
    found = rows.join(F.broadcast(drawn), "draw").groupBy("draw").agg(F.first("text").alias("text"))
    return fit([r["text"] for r in sorted(found.collect(), key=lambda r: r["draw"])])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(
    docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: its key, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and
    all spans, as a string and as a list ``found`` of (kind, start, end); ``settled`` is false where
    the field's messages did not settle, so that its spans may differ from those at rest."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), _text(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_settled(field, batch.column("text").to_pylist())
            counts = [pa.array([sum(s[0] == k for s in b) for b, _, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    *counts,
                    pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _, _ in found]),
                    pa.array([written(a) for _, a, _ in found], pa.string()),
                    pa.array(
                        [[{"kind": k, "start": s, "end": e} for k, s, e in a] for _, a, _ in found], SPANS
                    ),
                    pa.array([rest for _, _, rest in found], pa.bool_()),
                ],
                names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found", "settled"],
            )

    return rows.mapInArrow(
        run,
        f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "spans string, found array<struct<kind:string,start:long,end:long>>, settled boolean",
    ).withColumnRenamed("id", key)


def without_personal_data(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """All rows and columns, with the spans of the texts replaced by their kinds; nulls stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = find(field, [t or "" for t in texts])
            clean = [None if t is None else redacted(t, a) for t, (_, a) in zip(texts, found, strict=True)]
            columns = [*batch.columns[:at], pa.array(clean, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
