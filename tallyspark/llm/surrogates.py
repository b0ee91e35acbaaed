"""Operator 10, PII: detected entities get keyed surrogates of their type.

*Detection* (whole texts): e-mail addresses, phone numbers, IPv4 addresses,
payment cards, IBANs, US social security numbers, access keys and values
assigned to words such as password or token, and person names: up to three
words after a title, a listed given name and the words after it, and in the
same text every capitalised mention of a word of such a name.  Not detected
are names without a title whose given name is not listed, and a lone surname
in a text that does not name the person so.

*Surrogates.*  An entity is one or more units (an address's mailbox and its
domain, a name's words, a number's digits); a unit's surrogate is drawn from
a stream keyed by the secret, its kind, its canonical form and an attempt
number.  Format stays: separators, lengths, letter case, country codes, card
issuer digit and check digits, private address ranges, key prefixes.  Names
keep script and gender: the title decides it, where that is neutral or absent
the given-name lists, then another mention in the text.  The canonical
form ignores case and separators, so one entity has one surrogate wherever
and however it is written.

*Collision checks.*  All distinct units of the table are gathered (a small
shuffle); a unit whose surrogate another unit of its kind also has, or that
is a real unit itself, gets the next attempt until none is left; from
attempt ``WIDER`` on private addresses are drawn from 10/8.  If units still
collide after ``ATTEMPTS`` rounds (their format has too few values), the
operator fails.  The texts
are then rewritten with attempt 0 unless the unit is among those; which
documents hold such a unit is joined to them.

Null texts stay null, empty ones empty; texts without entities stay as they
are; equal rows (id and text) have equal results; an empty table gives an
empty one.  Of units of one kind with one surrogate that of the most attempts
keeps it, then the first by its text.  Other columns pass; a result column
whose name the input has gets a trailing underscore.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free, table
from .templates import row_key

KEY = b"replace with a secret of your own"
ATTEMPTS = 40
WIDER = 8

# Titles by gender, given names by script and gender.
TITLES = {"m": "Mr Mister Sir Herr Herrn Monsieur Señor Don Г-н Господин Κύριος".split(),
          "f": "Mrs Ms Miss Madam Frau Madame Mademoiselle Mme Mlle Señora Señorita Doña Г-жа Госпожа Κυρία".split(),
          "n": "Dr Prof Professor Doctor Docteur Doktor".split()}
GIVEN = {("latin", "m"): "James Peter Thomas Lucas Daniel Anton Felix Hugo Martin Oscar Victor Simon Paul Robert Louis Karl".split(),
         ("latin", "f"): "Anna Clara Emma Julia Laura Marie Sophie Helen Irene Alice Nora Lucia Elena Diana Rosa Eva".split(),
         ("latin", "n"): "Alex Robin Kim Sasha Charlie Jordan Morgan Taylor Jamie Casey Noel Toni".split(),
         ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Павел Михаил Олег".split(),
         ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Юлия Вера".split(),
         ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Πέτρος Αλέξης".split(),
         ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ιωάννα".split()}
# Further given names that are detected, not drawn.
KNOWN = {("latin", "m"): """John William Michael David Richard Joseph Charles Christopher Matthew Mark Andrew Steven Kenneth George Edward Brian
         Kevin Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Eric Jonathan Stephen Benjamin Samuel Gregory Patrick Frank Alexander Jack Henry
         Peter Hans Klaus Jürgen Wolfgang Pierre Jean Jacques François Juan José Carlos Luis Pedro Giovanni Giuseppe Marco Ahmed Mohammed Ali""".split(),
         ("latin", "f"): """Mary Maria Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily
         Kimberly Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Catherine Katherine Jane Ann Anne
         Monika Ursula Petra Claire Camille Isabelle Carmen Ana Lucía Giulia Francesca Fatima Aisha""".split()}
GENDER = {(script, x.lower()): g for names in (KNOWN, GIVEN) for (script, g), v in names.items() for x in v}
# Words that end a name though they are capitalised.
STOPS = """The A An And Or But Of In On At To For From By With As Is Was Were Are Has Had Have Said Says He She It They We You I His Her Its Their Our
Your This That These Those Then When Where Who What Why How Not No Yes If So
Monday Tuesday Wednesday Thursday Friday Saturday Sunday""".split()
SYLLABLES = {"latin": "ba be bo da del dor fa fen gar hal har ka kel lan lor ma mer mon na nor pa per ra ren ros sa sel ta tor van vel win".split(),
             "cyrillic": "ба бе во го да де зо ка ко ла ло ма ми на не по ра ре се со та то".split(),
             "greek": "βα γε δα κα κο λα λο μα με νι πα πο ρα ρο σα τα το φι χα".split()}
SURNAME_END = {"latin": "er man son ley ton berg".split(), "cyrillic": "ов ин ев".split(), "greek": "ος ης ας".split()}

_any = lambda words: "|".join(sorted({re.escape(y) for x in words for y in (x, x.upper())}, key=len, reverse=True))
_capital = r"(?=[^\W\d_a-zа-яёα-ωά-ώ])"
_name = r"[^\W\d_a-zа-яё]\w*(?:['’-](?!s\b)\w+)*"
_first = rf"(?!(?:{_any(STOPS)})\b){_name}"
_titles = _any(x for v in TITLES.values() for x in v)
_more = rf"[ \u00a0](?!(?:{_titles})\b){_first}"
_given = _any(x for names in (GIVEN, KNOWN) for v in names.values() for x in v)
_PATTERNS = [
    ("email", r"(?<![\w.%+-])[A-Za-z0-9_%+-][\w.%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\b[sp]k_(?:live|test)_[A-Za-z0-9]{16,}+"),
    ("secret", r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_+/.~-]{6,}+)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\(?\d{2,5}\)?[ ./-]\d{3,4}[ .-]\d{3,4}|\d{1,4}(?:[ .-]\d{2}){4})(?!\w|[.-]\d)"
              r"|(?<![\w.])\+\d{7,15}(?!\w)"),
    ("name", rf"\b{_capital}(?P<title>{_titles})\b\.?[ \u00a0]+(?P<who>{_first}(?:{_more}){{0,2}})"),
    ("full", rf"\b{_capital}(?:{_given})(?:{_more}){{1,2}}"),
]
_ALL = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in _PATTERNS))
# Every pattern needs one of these: @, a digit, a sign of assignment, a key prefix, a title or a given name.
_HINT = re.compile(rf"[@\d=:_]|\b{_capital}(?:AKIA|ASIA|(?:{_titles}|{_given})\b)")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


class Stream:
    """Keyed numbers of one unit and attempt."""

    def __init__(self, key: bytes, kind: str, unit: str, attempt: int) -> None:
        self.seed, self.n, self.left = f"{kind}\0{unit}\0{attempt}".encode(), 0, []
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def below(self, n: int) -> int:
        if not self.left:
            block = hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key).digest()
            self.left, self.n = [int.from_bytes(block[i:i + 4], "big") for i in range(0, 64, 4)], self.n + 1
        return self.left.pop() % n


def _shape(text: str, s: Stream) -> str:
    """Letters for letters of their case, digits for digits; hexadecimal stays so."""
    hexa = len(text) >= 8 and re.fullmatch(r"[0-9a-f]+", text) is not None and re.search(r"[0-9]", text) is not None and re.search(r"[a-f]", text) is not None
    out = []
    for c in text:
        if hexa:
            out.append("0123456789abcdef"[s.below(16)])
        elif c.isdigit():
            out.append(str(s.below(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr((65 if c.isupper() else 97) + s.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10


def _script(word: str) -> str:
    return "cyrillic" if re.search("[а-яёА-ЯЁ]", word) else "greek" if re.search("[α-ωά-ώΑ-Ω]", word) else "latin"


def surrogate(key: bytes, kind: str, unit: str, attempt: int = 0) -> str:
    """The surrogate of a unit in canonical form."""
    s = Stream(key, kind, unit, attempt)
    if kind == "mailbox":
        return _shape(unit.partition("@")[0], s) + "".join(chr(97 + s.below(26)) for _ in range(2 * attempt))
    if kind == "domain":
        head, _, last = unit.rpartition(".")
        return _shape(head, s) + "".join(chr(97 + s.below(26)) for _ in range(2 * attempt)) + "." + last
    if kind in ("key", "secret"):
        m = re.match(r"(?:AKIA|ASIA|gh[pousr]_|[sp]k_(?:live|test)_)", unit) if kind == "key" else None
        return (m[0] if m else "") + _shape(unit[m.end() if m else 0:], s)
    if kind == "card":
        body = unit[0] + "".join(str(s.below(10)) for _ in unit[1:-1])
        if _luhn(unit) == 0:
            return body + str(-_luhn(body + "0") % 10)
        return body + str(s.below(10))
    if kind == "iban":
        body = _shape(unit[4:], s)
        number = "".join(str(int(c, 36)) for c in body + unit[:2] + "00")
        return unit[:2] + f"{98 - int(number) % 97:02d}" + body
    if kind == "ssn":
        area = 1 + s.below(898)
        return f"{area + (area >= 666):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "ip":
        a = [int(x) for x in unit.split(".")]
        fixed = 1 if a[0] in (10, 127) else 2 if a[0] == 192 and a[1] == 168 or a[0] == 172 and 16 <= a[1] < 32 else 0
        free = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        out = ([10] if fixed == 2 and attempt >= WIDER else a[:fixed]) or [free[s.below(len(free))]]
        return ".".join(map(str, out + [s.below(256) for _ in range(4 - len(out))]))
    if kind == "phone":
        code, _, rest = unit.rpartition(":")
        return f"{code}:{2 + s.below(8)}" + "".join(str(s.below(10)) for _ in rest[1:])
    gender, script, word = unit.split(":")
    syllables = SYLLABLES[script]
    if kind == "given" and attempt == 0:
        names = GIVEN.get((script, gender)) or GIVEN[script, "m"]
        return names[s.below(len(names))].lower()
    built = "".join(syllables[s.below(len(syllables))] for _ in range(2 + attempt // 2))
    if kind == "given":
        return built + {"f": {"latin": "a", "cyrillic": "а", "greek": "α"}, "m": {"latin": "o", "cyrillic": "й", "greek": "ος"}}.get(gender, {}).get(script, "")
    end = SURNAME_END[script][s.below(len(SURNAME_END[script]))]
    return built + end + ("а" if script == "cyrillic" and gender == "f" else "")


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:]


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its letters and digits replaced one after the other."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape) + "".join(it)


def _parts(m: re.Match) -> tuple[int, int, list[tuple[str, str]]]:
    """(start, end, [(kind, canonical unit)]) of a detected entity but a name."""
    kind = next(k for k, _ in _PATTERNS if m[k] is not None)
    start, end = m.span("value" if kind == "secret" else kind)
    text = m.string[start:end]
    if kind == "email":
        low = text.lower()
        return start, end, [("mailbox", low), ("domain", low.partition("@")[2])]
    if kind in ("card", "ssn"):
        return start, end, [(kind, re.sub(r"\D", "", text))]
    if kind == "iban":
        return start, end, [(kind, text.replace(" ", ""))]
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        digits = re.sub(r"\D", "", text[code.end() if code else 0:])
        return start, end, [(kind, f"{code[0] if code else ''}:{digits}")]
    return start, end, [(kind, text)]


def _person(m: re.Match) -> tuple[int, int, str, list[str]] | None:
    """(start, end, gender by the title, words) of a detected name."""
    kind = "who" if m["name"] is not None else "full"
    if m[kind] is None:
        return None
    title = m["title"] and m["title"].capitalize()
    return *m.span(kind), next((g for g, names in TITLES.items() if title in names), "n"), m[kind].lower().replace("\u00a0", " ").split(" ")


class _People:
    """The names detected in a text, as units."""

    def __init__(self, people: list[tuple[int, int, str, list[str]]]) -> None:
        self.surnames = {words[-1] for *_, words in people if len(words) > 1}
        self.given, said = {}, {}
        for *_, gender, words in people:
            for w in words[:-1]:
                self.given.setdefault(w, gender)
                if gender != "n":
                    said.setdefault(w, set()).add(gender)
        self.said = {w: g.pop() for w, g in said.items() if len(g) == 1}
        # a word alone after a title is a surname unless the text has it only as a given name
        self.surnames |= {words[0] for *_, words in people if len(words) == 1 and words[0] not in self.given}

    def unit(self, word: str, gender: str | None = None) -> tuple[str, str] | None:
        """The unit of a given name, or without a gender of a word alone."""
        script = _script(word)
        if gender is None and word in self.surnames:
            return "surname", f"{'f' if script == 'cyrillic' and word.endswith(('а', 'я')) else 'n'}:{script}:{word}"
        if gender is None and word not in self.given:
            return None
        gender = gender or self.given[word]
        if gender == "n":
            gender = GENDER.get((script, word), "n")
        return "given", f"{self.said.get(word, 'n') if gender == 'n' else gender}:{script}:{word}"

    def units(self, gender: str, words: list[str]) -> list[tuple[str, str]]:
        if len(words) == 1:
            return [self.unit(words[0])]
        return [*(self.unit(w, gender) for w in words[:-1]), self.unit(words[-1])]

    def mentions(self, text: str, start: int, end: int):
        """(start, end, units) of capitalised mentions, one for words that follow each other."""
        run = None
        for w in _WORD.finditer(text, start, end):
            whole = w[0][0].isupper() and self.unit(w[0].lower())
            for m in [w] if whole else re.compile(r"[^\W_]+").finditer(text, *w.span()):
                unit = m[0][0].isupper() and m[0] not in STOPS and self.unit(m[0].lower())
                if not unit:
                    continue
                if run and text[run[1]:m.start()] in (" ", "\u00a0"):
                    run = run[0], m.end(), [*run[2], unit]
                else:
                    if run:
                        yield run
                    run = m.start(), m.end(), [unit]
        if run:
            yield run


def entities(text: str | None):
    """(start, end, units) of the entities of a text, in order."""
    if not text or not _HINT.search(text):
        return
    found = [(_person(m), m) for m in _ALL.finditer(text)]
    people = _People([p for p, _ in found if p])
    at = 0
    for person, m in found:
        start, end, units = (*person[:2], people.units(*person[2:])) if person else _parts(m)
        if people.surnames:
            yield from people.mentions(text, at, start)
        yield start, end, units
        at = end
    if people.surnames:
        yield from people.mentions(text, at, len(text))


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and the number of entities replaced."""
    out, at, n = [], 0, 0
    for start, end, units in entities(text):
        own, new = text[start:end], [surrogate(key, k, u, attempts.get((k, u), 0)) for k, u in units]
        kind = units[0][0]
        if kind == "mailbox":
            new = "@".join(new)
            if own.upper() == own != own.lower():
                new = new.upper()
        elif kind == "phone":
            code, _, digits = new[0].rpartition(":")
            new = code + _fill(own[len(code):], digits)
        elif kind in ("given", "surname"):
            new = " ".join(_cased(w, o) for w, o in zip(new, own.replace("\u00a0", " ").split(" ")))
        else:
            new = new[0] if kind in ("ip", "key", "secret") else _fill(own, new[0])
        out += [text[at:start], new]
        at, n = end, n + 1
    return ("".join([*out, text[at:]]), n) if n else (text, 0)


# --- on Spark -----------------------------------------------------------------

def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, kind, unit): the units of every row, once per row."""
    def run(batches):
        for batch in batches:
            keys, kinds, units = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, unit in {u for _, _, us in entities(text) for u in us}:
                    keys.append(key)
                    kinds.append(kind)
                    units.append(unit)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds), pa.array(units)], ["key", "kind", "unit"])

    return docs.select(row_key(id_col, text_col), F.col(text_col)).mapInArrow(run, "key long, kind string, unit string")


def _drawn(units: DataFrame, key: bytes) -> DataFrame:
    """(kind, unit, attempt, made): with the surrogate in canonical form; a
    mailbox's is compared together with its domain."""
    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            made = [surrogate(key, k, u, a) + ("@" + u.partition("@")[2] if k == "mailbox" else "") for k, u, a in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], ["kind", "unit", "attempt", "made"])

    return units.select("kind", "unit", "attempt").mapInArrow(run, "kind string, unit string, attempt int, made string")


def _real(kind: str, unit: str):
    """A unit as its surrogate would be written."""
    return F.when(F.col(kind).isin("given", "surname"), F.substring_index(F.col(unit), ":", -1)).otherwise(F.col(unit))


def attempts_needed(held: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, unit, attempt) of the units whose first surrogate collides,
    with the first attempt that does not."""
    units = table(held.select("kind", "unit").distinct(), "pii-units")
    real = units.select("kind", _real("kind", "unit").alias("made")).distinct().withColumn("taken", F.lit(True))
    drawn = table(_drawn(units.withColumn("attempt", F.lit(0)), key), "pii-drawn")
    for attempt in range(1, ATTEMPTS + 2):
        first = drawn.groupBy("kind", "made").agg(F.min(F.struct((-F.col("attempt")).alias("a"), "unit")).alias("owner"), F.count("*").alias("n"))
        judged = drawn.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
        judged = judged.select("kind", "unit", "attempt", "made", (F.col("taken").isNotNull() | (F.col("n") > 1) & (F.col("owner.unit") != F.col("unit"))).alias("bad"))
        judged = table(judged, "pii-judged")
        if judged.where("bad").isEmpty():
            break
        if attempt > ATTEMPTS:
            left = judged.where("bad").groupBy("kind").count().collect()
            raise RuntimeError(f"no distinct surrogates after {ATTEMPTS} rounds: " + ", ".join(f"{r['count']} of kind {r['kind']}" for r in left))
        again = _drawn(judged.where("bad").withColumn("attempt", F.lit(attempt)), key)
        drawn = table(judged.where("not bad").select("kind", "unit", "attempt", "made").unionByName(again), "pii-drawn")
    return drawn.where("attempt > 0").select("kind", "unit", "attempt")


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY, out: str = "_entities") -> DataFrame:
    """``docs`` with the text rewritten, and the number of its entities as column ``out``."""
    held = table(_units(docs, id_col, text_col), "pii-held")
    changed = table(attempts_needed(held, key), "pii-attempts")
    row, own = free(docs, "_row"), free(docs, "_changed")
    out = free(docs, out)
    per_row = held.join(changed, ["kind", "unit"]).groupBy("key").agg(F.collect_set(F.struct("kind", "unit", "attempt")).alias(own))
    per_row = table(per_row.withColumnRenamed("key", row), "pii-rows")
    names = docs.columns
    at, n = names.index(text_col), len(names)

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                text, count = rewrite(text, key, {(x["kind"], x["unit"]): x["attempt"] for x in own or ()}) if text else (text, 0)
                texts.append(text)
                counts.append(count)
            cols = list(batch.columns[:n])
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32())], [*names, out])

    joined = docs.join(per_row, row_key(id_col, text_col) == F.col(row), "left").select(*[F.col(f"`{c}`") for c in docs.columns], own)
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.IntegerType())]))
