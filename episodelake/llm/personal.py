"""Personal information inside free text (problem 8).

Broad patterns propose spans of each kind in the whole of every text. Labelers - regular expressions for form and borders, the
gazetteer of name parts, words of context on either side - vote for, against or not at all. How often each combination of
votes occurs is counted over all documents; expectation-maximisation over these counts (Dawid and Skene) estimates, per
kind, how reliable each labeler is and how probable each combination is a mention. With that as soft labels a logistic
regression over the votes and a few pairs of them is trained, the span classifier that decides; where spans overlap the likelier
stays. The counts are a few hundred rows whatever the number of documents; name_parts has a fixed number of rows.

Redaction puts [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS] or [PERSON_NAME] for each span found; all else stays byte by byte.

Defined cases: null and empty texts have no mentions (redacted they stay null and empty); positions are in Unicode
characters; embedded base64 data are no text; repeated doc_ids give their mentions each; extra columns play no part; an
empty table gives no rows."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodelake.sources import table
from episodelake.sources.tables import cut

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: Characters of context that labelers see on either side.
LEFT, RIGHT = 48, 40
THRESHOLD = 0.5

# Words of context, by what they speak for.
MAIL = r"mail|contact|notify|write|e-?mail|to|from|cc|written|author|go|schreiben|escribir|correo|courriel"
PHONE = r"tel|phone|call|ring|fax|mobile|cell|joindre|anrufen|llamar|ligar|telefon|teléfono|appeler|handy"
IDENTITY = r"ssn|social security|tax id|national[ _]id|identity|id[ _]?card|ni number|dni|nif|nie|ausweis(?:-?nr)?|passport|personal no|insurance"
PLACE = r"addr|address|street|visits?|anschrift|adresse|dirección|colis|lives|home|ship|deliver|morada|wohn"
PERSON = r"author|by|dr|mr|mrs|ms|prof|written|reviewed|contact|customer|name|volunteer|to|thanks|joindre|au|an|owner|user|maintainer|von|par|por|go"
OTHER = r"lot|run|order|batch|job|serial|version|build|part|invoice|ticket|port|seed"


def fold(x: str) -> str:
    return unicodedata.normalize("NFC", x).casefold()


class Names:
    """The gazetteer: listed parts, and, as not all in use are listed, what several listed parts' beginnings and endings make."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = {fold(x) for x in given}, {fold(x) for x in family}
        self.near_given, self.near_family = self.wider(given), self.wider(family)

    @staticmethod
    def wider(parts: set[str]) -> set[str]:
        starts, ends = defaultdict(set), defaultdict(set)
        for p in parts:
            for i in range(2, len(p)):
                starts[p[:i]].add(p[i:])
                ends[p[i:]].add(p[:i])
        cut_ = {(p[:i], p[i:]) for p in parts for i in range(2, len(p)) if len(starts[p[:i]]) >= 3 and len(ends[p[i:]]) >= 4}
        return {fold(x) for x in parts | {a + b for a in {a for a, _ in cut_} for b in {b for _, b in cut_}}}

    def vote(self, word: str, role: str) -> int:
        listed, near = (self.given, self.near_given) if role == "given" else (self.family, self.near_family)
        parts = [fold(x) for x in word.split("-")]
        return 1 if all(p in listed for p in parts) else 0 if all(p in near for p in parts) else -1


class Finder:
    """Candidate spans of a text with their votes: (start, end, kind, votes)."""

    def __init__(self, given: set[str], family: set[str]):
        self.names = Names(given, family)
        word = r"[A-ZÀ-ÖØ-Þ][^\W\d_̀]*(?:[̀-ͯ][^\W\d_]*)*"
        gap = r"(?:[ \t ]+|[ \t]*\r?\n[ \t]*)"
        caps = r"[A-ZÀ-Þ][\w'’-]+"
        # Each begins with a set of characters, which makes its search fast; what may not stand before comes second.
        self.pair = re.compile(rf"([A-ZÀ-ÖØ-Þ](?<![^\W_].)[^\W\d_]*(?:[̀-ͯ][^\W\d_]*)*(?:-{word})*)(?=(,?){gap}(?:([A-ZÀ-Þ])\.?{gap})?({word}(?:-{word})*))")
        self.user = re.compile(r"(?<![\w.+%-])[A-Za-z0-9À-ɏ][\w.+%-]*[ ]?$")
        self.host = re.compile(r"@(?:[\w-]+\.)+[\w-]+(?![\w-])")
        dots = r"(?:\.|[ ]?[\[({<][ ]?(?:dot|DOT|Dot)[ ]?[\])}>][ ]?|[ ](?:DOT|dot)[ ])"
        self.spelt = re.compile(rf"[\[({{<][ ]?(?:at|AT|At)[ ]?[\])}}>][ ]?[\w-]+(?:{dots}[\w-]+)+")
        self.spoken = re.compile(r"[ ](?:AT|at)[ ][\w-]+(?:(?:[ ](?:DOT|dot)[ ]|\.)[\w-]+)*[ ](?:DOT|dot)[ ][\w-]+")
        self.digits = re.compile(r"[+(0-9](?<![\w.+/-].)[\d() ./-]{8,30}")
        self.phone = re.compile(
            r"(?<![\w.+/-])(?<!\d[ ])(?:"
            r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ ./-]?\d{2,5}){1,4}"
            r"|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}"
            r"|0\d{4}[ ]\d{6}|0\d{2}[ ]\d{4}[ ]\d{4}|0\d{3}[ ]\d{3}[ ]\d{4}|0\d{1,4}/\d{6,9}|0\d(?:[ .]\d\d){4})(?!\d)"
        )
        self.number = re.compile(r"[0-9A-Z](?<![\w./+-].)(?<!\d[ ].)(?:(?<=\d)\d\d-\d\d-\d{4}|(?<=[A-Z])[A-Z] ?\d\d ?\d\d ?\d\d ?[A-Z]|(?<=\d)\d ?\d{3} ?\d{3} ?\d{3})(?!\w)")
        self.street = re.compile(
            rf"[0-9](?<![\w.,/-].)\d{{0,4}}(?:[A-Za-z]?,?{gap}(?:{caps}{gap}){{1,3}}?(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Crescent|Cres|Boulevard|Blvd|Way|Terrace|Place|Close|Square)\b\.?"
            rf"|(?: bis| ter)?,?{gap}(?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|route|cours)[ ](?:(?:de la|de l['’]|du|des|de|d['’])[ ]?)?{caps})"
        )
        self.named = re.compile(rf"(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|Rua|Via|Ronda|calle|avenida|rue|chemin)[ ](?:(?:de la|del|de|du)[ ])?{caps},?[ ]\d{{1,5}}\b")
        self.ending = re.compile(r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer)[ ]\d{1,5}\b")
        self.capital = re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß]+$")
        self.blob = re.compile(r"[A-Za-z0-9+/]{80,}={0,2}")
        before = lambda words: re.compile(rf"(?i)(?:^|[^\w])(?:{words})(?:[ _]?(?:id|no|nr|number|file))?\.?(?: on file)?[\W_]{{0,6}}$")
        self.before = {k: before(w) for k, w in (("email", MAIL), ("phone", PHONE), ("id_number", IDENTITY), ("street_address", PLACE), ("person_name", PERSON), ("other", OTHER))}
        self.sent = re.compile(r"(?i)\b(?:ship|send|deliver|envoyer|colis|senden|schicken|enviar|enviad|mandar)\w*\b[^\n]{0,40}$")
        self.lot = re.compile(r"(?i)^[^\w\n]{0,6}(?:lot|run|order|batch|job|serial)\b")
        self.remote = re.compile(r"^:[\w~/]")
        self.town = re.compile(r"^[.,]?(?: ?#\d+| (?:Flat|Apt|Unit|Suite)\.? \w+)?,?(?:[ ]|\r?\n)*(?:\d{5}|[A-ZÀ-Þ])")
        self.title = re.compile(r"(?i)^\W{0,3}(?:section|chapter|table|figure|step|exercise)s?\b")

    def text(self, text: str) -> str:
        """The text with embedded data blanked out, as long as before."""
        if "base64" not in text and "image/" not in text:
            return text
        return self.blob.sub(lambda m: "\0" * (m.end() - m.start()), text)

    def candidates(self, text: str) -> list[tuple[int, int, str, tuple[int, ...]]]:
        text = self.text(text)
        left = lambda i: text[max(0, i - LEFT) : i]
        right = lambda i: text[i : i + RIGHT]
        label = lambda kind, before: 1 if self.before[kind].search(before) else -1 if self.before["other"].search(before) else 0
        sign = lambda x: 1 if x else -1
        out = []

        for form, p in enumerate((self.host, self.spelt, *[self.spoken] * (" DOT " in text or " dot " in text))):
            for m in p.finditer(text):
                head = text[max(0, m.start() - 80) : m.start()]
                u = self.user.search(head)
                if not u or (form == 0 and head[-1:] == " "):
                    continue
                start = m.start() - len(u.group())
                before, after, tail = left(start), right(m.end()), re.split(r"[.\])}> ]", m.group())[-1]
                votes = (
                    sign(tail.isalpha() and len(tail) >= 2),  # a top-level domain
                    # a repository's remote or a package's version
                    sign(not (self.remote.match(after) or before.endswith("//") or re.search(r"(?:clone|remote|ssh|origin) (?:\S+ )?$", before) or form == 0 and re.match(r"@v?\d", m.group()))),
                    -1 if u.group().strip().lower() in ("git", "hg", "svn", "root", "www") else 0,
                    1 if form else 0,  # nobody spells out what isn't meant for people
                    label("email", before) or (1 if before[-1:] in ("\"'<:|(,") and before[-1:] else 0),
                    0 if after[:1] in ("\"'>|),; \n\r\\.") else -1,
                )
                out.append((start, m.end(), "email", votes))

        for x in self.digits.finditer(text):
            for m in self.phone.finditer(text, x.start(), min(len(text), x.end() + 3)):
                before, after, s = left(m.start()), right(m.end()), m.group()
                n = sum(map(str.isdigit, s))
                votes = (
                    sign(9 <= n <= 14),
                    label("phone", before),
                    1 if s[0] in "+(" else 0 if s[0] == "0" or "-" in s or "." in s else -1,
                    -1 if re.match(r"[\w=-]|[./]\d", after) or re.search(r"[\w=][ ]?$", before[-1:]) else 1,
                    -1 if self.lot.match(after) else 0,
                    1 if re.match(r"\s*(?:[\"'|,.;)\]<\\]|$)|\s", after) else -1,
                )
                out.append((m.start(), m.end(), "phone", votes))

        for m in self.number.finditer(text):
            before, after, s = left(m.start()), right(m.end()), m.group()
            votes = (
                label("id_number", before),
                -1 if self.lot.match(after) else 0,
                1 if "-" in s or " " in s or s[0].isalpha() else -1,  # written as an identity number is
                sign(s[0] == "9" if s[3:4] == "-" else s[:2] in ("QQ", "00")),  # of the ranges kept for examples
                self.person_before(before),
                -1 if re.match(r"[-=]|[./]\d", after) else 1,
            )
            out.append((m.start(), m.end(), "id_number", votes))

        spots = [m.span() for p in (self.street, self.named) for m in p.finditer(text) if p is self.street or not text[m.start() - 1 : m.start()].isalnum()]
        for m in self.ending.finditer(text):
            if w := self.capital.search(text, max(0, m.start() - 40), m.start()):
                spots.append((w.start(), m.end()))
        for a, z in spots:
            before, after, s = left(a), right(z), text[a:z]
            votes = (
                1 if self.sent.search(before) else label("street_address", before),
                sign(self.town.match(after)),
                -1 if self.title.match(after) or re.search(r"(?i)(?:table|figure|section|step|cell|epoch) $", before) else 0,
                sign(re.search(r"(?:^|\D)\d{1,4}(?:\D|$)", s)),
                1 if before[-2:] in (": ", "'", '"', "· ") or before[-1:] in ("'\"") else 0,
            )
            out.append((a, z, "street_address", votes))

        for m in self.pair.finditer(text):
            a, comma, initial, b = m.groups()
            first, last = (b, a) if comma else (a, b)
            if "-" in first:
                continue
            before, after = left(m.start()), right(m.end(4))
            given, family = self.names.vote(first, "given"), self.names.vote(last, "family")
            votes = (
                max(given, 0),  # listed
                max(family, 0),
                sign(given >= 0),  # made as listed ones are
                sign(family >= 0),
                1 if self.before["person_name"].search(before) else 0,
                -1 if self.title.match(after) else 0,
                1 if re.match(r"[ ]?[|(\"'<]|, ?[\w.+-]+ ?[@\[(]| wrote|,", after) else 0,
                1 if initial else 0,
            )
            out.append((m.start(), m.end(4), "person_name", votes))
        return out

    def person_before(self, before: str) -> int:
        """A listed name shortly before."""
        words = re.findall(r"[A-ZÀ-Þ][^\W\d_]+", before)
        return 1 if any(self.names.vote(w, "family") >= 0 for w in words) and any(self.names.vote(w, "given") >= 0 for w in words) else 0


def coded(votes: tuple[int, ...]) -> str:
    return "".join("-0+"[v + 1] for v in votes)


#: What a labeler is taken to do before anything is seen: its votes' probabilities (against, none, for), given no mention and
#: given a mention; and how much that weighs beside the data.
BEFOREHAND = np.array([[0.45, 0.45, 0.1], [0.05, 0.5, 0.45]])
WEIGHT = 0.3


def reliabilities(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Probability of each combination of votes to be a mention, each labeler's probabilities of a vote given (not mention,
    mention), and the share of mentions. Expectation-maximisation from the votes' sum."""
    codes = sorted(counts)
    v = np.array([["-0+".index(x) for x in c] for c in codes])
    n = np.array([counts[c] for c in codes], float)
    p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))
    table_ = np.zeros((v.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        for j in range(v.shape[1]):
            for k in range(3):
                table_[j, :, k] = weight[:, v[:, j] == k].sum(1) + (WEIGHT * weight.sum(1) + 1.0) * BEFOREHAND[:, k]
        table_ /= table_.sum(2, keepdims=True)
        prior = min(max(weight[1].sum() / n.sum(), 1e-4), 1 - 1e-4)
        odds = np.log(prior / (1 - prior)) + sum(np.log(table_[j, 1, v[:, j]] / table_[j, 0, v[:, j]]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return dict(zip(codes, p.tolist())), table_, prior


def features(code: str) -> list[float]:
    """One for each vote for and against, and for pairs of opposed votes."""
    single = [float(x == s) for x in code for s in "+-"]
    pairs = [float(a != b and "0" not in (a, b)) for i, a in enumerate(code) for b in code[i + 1 :]]
    return [1.0, *single, *pairs]


def classifier(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Logistic regression on the soft labels, weighted by how often a combination occurs: its score of each combination."""
    if not counts:
        return {}
    soft, _, _ = reliabilities(counts)
    codes = sorted(counts)
    x, y = np.array([features(c) for c in codes]), np.array([soft[c] for c in codes])
    n = np.array([counts[c] for c in codes], float)
    n = n / n.sum() * 1000 + 0.05  # rare combinations are heard too
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's method; the ridge keeps it well posed
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.02 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - 0.02 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def chosen(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Spans without overlaps, in order; of overlapping ones the likelier stays, of those alike the one that begins first, then the longer."""
    out: list[tuple[int, int, str, float]] = []
    for s in sorted(spans, key=lambda x: (x[0], -x[1])):
        if out and s[0] < out[-1][1]:
            if s[3] > out[-1][3] + 1e-9:
                out[-1] = s
        else:
            out.append(s)
    return [s[:3] for s in out]


def gazetteer(name_parts: DataFrame) -> tuple[set[str], set[str]]:
    rows = name_parts.where("name_part is not null").select("role", "name_part").distinct().collect()  # fixed number
    return {r["name_part"] for r in rows if r["role"] == "given"}, {r["name_part"] for r in rows if r["role"] == "family"}


def proposed(documents: DataFrame, names: tuple[set[str], set[str]]) -> DataFrame:
    """doc_id, spans (start, stop, kind, votes) of each text with candidates."""

    def propose(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find = Finder(*names)
        kinds = {k: i for i, k in enumerate(KINDS)}
        item = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int8()), ("votes", pa.string())])
        for b in batches:
            ids, spans = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = [{"start": a, "stop": z, "kind": kinds[k], "votes": coded(v)} for a, z, k, v in find.candidates(t)]
                if own:
                    ids.append(i)
                    spans.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(item))], names=["doc_id", "spans"])

    texts = documents.where("length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(propose, "doc_id long, spans array<struct<start:int,stop:int,kind:tinyint,votes:string>>")


def trained(spans: DataFrame) -> dict[tuple[str, str], float]:
    """The score of each kind and combination of votes, from the counts over all documents."""
    counted = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n"))
    counts: dict[str, dict[str, int]] = {k: {} for k in KINDS}
    for r in counted.collect():  # at most 3**8 combinations a kind
        counts[KINDS[r["kind"]]][r["votes"]] = r["n"]
    return {(k, code): p for k, c in counts.items() for code, p in classifier(c).items()}


def mentions(documents: DataFrame, name_parts: DataFrame) -> DataFrame:
    """doc_id, kind, start_pos, end_pos, score is left to the classifier: one row per mention."""
    spans = cut(proposed(documents, gazetteer(name_parts)))
    scores = trained(spans)

    def decide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, own in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist()):
                told = [(s["start"], s["stop"], KINDS[s["kind"]], scores.get((KINDS[s["kind"]], s["votes"]), 0.0)) for s in own]
                rows += [(i, k, a, z) for a, z, k in chosen([t for t in told if t[3] > THRESHOLD])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "kind", "start_pos", "end_pos"])

    return spans.mapInArrow(decide, "doc_id long, kind string, start_pos long, end_pos long")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p8_found."""
    return mentions(table(spark, folder, "documents"), table(spark, folder, "name_parts")).drop("end_pos")


def replaced(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not text or not spans:
        return text
    parts, at = [], 0
    for a, z, kind in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join(parts) + text[at:]


def redaction(documents: DataFrame, name_parts: DataFrame) -> DataFrame:
    """doc_id, text of every document, mentions replaced. Texts are read again rather than joined with their spans: no shuffle."""
    names = gazetteer(name_parts)
    scores = trained(proposed(documents, names))

    def redact(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find = Finder(*names)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                told = [(a, z, k, scores.get((k, coded(v)), 0.0)) for a, z, k, v in find.candidates(t)] if t else []
                out.append(replaced(t, chosen([s for s in told if s[3] > THRESHOLD])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(redact, "doc_id long, text string")


def redacted(spark: SparkSession, folder: str) -> DataFrame:
    """p8_redacted."""
    return redaction(table(spark, folder, "documents"), table(spark, folder, "name_parts"))
