"""Personal data: detected entities get keyed surrogates of the same type and format.

Kinds: e-mail addresses, IP addresses of both versions, account (IBAN), social security and payment card numbers, telephone numbers,
and names after a form of address. One entity may be written in several forms (a telephone number with
or without spaces); its canonical value decides its surrogate, so it gets the same one everywhere. Within a text a full name is
also found without a form of address, and a surname with one stands for the one full name that ends in it.
Surrogates come from an HMAC of kind, value and attempt: digits stay digits, letters stay
letters of their case and script, numbers with check digits keep them right (or wrong), names keep gender and
script. A surrogate that another entity has too, or that is itself a value of the data, is
drawn again with the next attempt until every entity has one of its own.

The table of entities is joined, never broadcast; texts without entities are not shuffled.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import narrow, prepared, written

# Session setting with the key of the surrogates. Without it, and without a key given, each application draws its own.
KEY_SETTING = "spark.basketlens.surrogates.key"

# Forms of address by gender, and names by script and gender.
TITLES = {
    "f": "Mrs Ms Miss Madame Mme Frau Señora Sra г-жа",
    "m": "Mr Monsieur Herr Señor Sr г-н",
    "": "Dr Prof",
}
GIVEN = {
    ("latin", "f"): "Anna Maria Julia Laura Emma Clara Sofia Nina Elena Lucia Sarah Marie Eva Irene Paula Alice",
    ("latin", "m"): "Paul Peter Lukas Martin David Jonas Carlos Pierre Thomas Hugo Simon Louis Mark Oscar Felix Bruno",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Светлана Юлия",
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Андрей Николай Павел Олег",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Δέσποινα Χριστίνα",
    ("greek", "m"): "Νίκος Δημήτρης Κώστας Παναγιώτης Ανδρέας Μιχάλης Σπύρος Θανάσης",
    ("han", "f"): "丽 芳 静 敏 婷 雪 娟 慧",
    ("han", "m"): "伟 强 军 勇 杰 涛 明 磊",
}
FAMILY = {
    "latin": "Keller Novak Moreau Silva Jensen Fischer Marin Costa Weber Dubois Romero Lang Petit Vidal Brandt Ortega",
    "cyrillic": "Иваненко Петренко Шевченко Бондаренко Ткаченко Кравченко Коваленко Олейник",
    "greek": "Αλεξίου Βλάχου Γεωργίου Δούκα Ζαφειρίου Ιωάννου Λάμπρου Νικολάου",
    "han": "李 张 刘 陈 杨 黄 赵 周",
}
SYLLABLES = {
    "latin": "ba de li mo nu ra se ti vo ka".split(),
    "cyrillic": "ба де ли мо ну ра се ти во ка".split(),
    "greek": "βα δε λι μο νου ρα σε τι βο κα".split(),
    "han": "安 宁 文 华 云 平 林 江 海 天".split(),
}
# Scripts whose names are made of letters of their own: first letter and number of letters.
LETTERS = {
    "arabic": ("ا", "ب ت ج د ر س ع ف ك ل م ن ه و ي".split()),
    "hebrew": ("א", "א ב ג ד ה ו ל מ נ ר ש ת".split()),
    "kana": ("ア", "ア イ カ キ サ シ タ ト ナ ニ マ ミ ラ リ".split()),
    "hangul": ("가", "김 이 박 최 정 수 민 지 영 현".split()),
    "devanagari": ("अ", "अ क ग ज त द न प म र ल व स ह".split()),
    "thai": ("ก", "ก ข ค ง จ ช ด ต น ป ม ร ล ว ส".split()),
}
# Words in lower case that join the parts of a name.
PARTICLES = set("von van der den de del della di da dos du la le el al bin ibn ter zu zum".split())
# Words before a number that say that it is a telephone's.
_CALLS = "(?i:tel|telephone|phone|fon|telefon|téléphone|teléfono|call|mobile|mobil|fax)"

_TITLE = "|".join(re.escape(t) for names in TITLES.values() for t in names.split())
_NAME = r"[^\W\d_][\w'’-]*"
_HEX = "[0-9A-Fa-f]"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    "ip6": re.compile(rf"(?<![\w:.])(?:{_HEX}{{0,4}}:){{2,7}}{_HEX}{{0,4}}(?![\w:])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"(?<![\dA-Za-z])(?:\d{4}[ -]){3}\d{4}(?![\dA-Za-z])|(?<![\dA-Za-z])\d{15,16}(?![\dA-Za-z])"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w])|\+\d{8,14}(?!\w)"),
    "called": re.compile(rf"(?<!\w){_CALLS}\W{{1,3}}(?P<phone>\d{{7,14}})(?!\w)"),
    "name": re.compile(rf"(?<!\w)(?:{_TITLE})\.? (?=(?P<name>{_NAME}(?: {_NAME}){{0,4}}))"),
}
_HINT = re.compile(rf"@|\d[\d .()-]{{5}}|{_HEX}*::?{_HEX}+:|[A-Z]{{2}}\d{{2}} ?[A-Z0-9]{{4}}|(?<!\w)(?:{_TITLE})\.? ")
_TITLE_GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
_GIVEN_GENDER = {n.lower(): g for (_, g), names in GIVEN.items() for n in names.split()}


def _begins_name(word: str) -> bool:
    """A capital, or a letter of a script without cases."""
    c = word[:1]
    return c.isupper() or (c.isalpha() and c.lower() == c.upper())


def _name_words(text: str) -> str:
    """The leading words that are parts of a name; particles only between such."""
    out: list[str] = []
    held: list[str] = []
    for word in text.split(" "):
        if word in _TITLE_GENDER:
            break
        if _begins_name(word):
            out += [*held, word]
            held = []
        elif out and word in PARTICLES:
            held.append(word)
        else:
            break
    return " ".join(out)


def canonical(kind: str, found: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "ip6":
        return ipaddress.IPv6Address(found).exploded
    if kind == "iban":
        return found.replace(" ", "")
    return found.lower()


def _valid(kind: str, found: str) -> bool:
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(found) is not None and len(found) > 4
        except ValueError:
            return False
    return kind != "iban" or checked(found.replace(" ", "")) == 1


def checked(iban: str) -> int:
    """The number of an account modulo 97; 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of entities that do not overlap, in order; earlier kinds win."""
    return [span[:4] for span in _entities(text)]


def _entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """detect with the canonical value, which for a surname alone is the full name it stands for."""
    if not _HINT.search(text):
        return []
    taken: list[tuple[int, int, str, str, str]] = []

    def take(start: int, end: int, kind: str, gender: str, value: str) -> None:
        if all(end <= a or start >= b for a, b, *_ in taken):
            taken.append((start, end, kind, gender, value))

    names = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            if kind == "name":
                name = _name_words(m["name"])
                if name:
                    title = text[m.start() : m.start("name")].strip(" .")
                    gender = _TITLE_GENDER.get(title, "") or _GIVEN_GENDER.get(name.split(" ")[0].lower(), "")
                    names.append((m.start("name"), m.start("name") + len(name), gender, name))
            elif kind == "called":
                take(m.start("phone"), m.end("phone"), "phone", "", m["phone"])
            elif _valid(kind, m[0]):
                take(m.start(), m.end(), kind, "", canonical(kind, m[0]))
    whole: dict[str, str] = {}
    for _, _, gender, name in names:
        if " " in name:
            whole[name] = max(whole.get(name, ""), gender)
    for start, end, gender, name in names:
        bearers = {n.lower() for n in whole if n.endswith(" " + name)} if " " not in name else set()
        value = bearers.pop() if len(bearers) == 1 else canonical("name", name)
        take(start, end, "name", gender, value)
    if whole:
        again = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(whole, key=lambda n: (-len(n), n))) + r")(?!\w)")
        for m in again.finditer(text):
            take(m.start(), m.end(), "name", whole[m[0]], canonical("name", m[0]))
    return sorted(taken)


class _Draw:
    """A keyed stream of numbers."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.seed, self.count, self.pool = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.count += 1
            self.pool += hmac.digest(self.key, self.seed + b"\x1f" + str(self.count).encode(), hashlib.sha256)
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value * n >> 32


def luhn(digits: str) -> int:
    """What the digits' checksum lacks to a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


# Ranges of Unicode blocks by script.
_SCRIPTS = {
    "cyrillic": "\u0400-\u052f", "greek": "\u0370-\u03ff\u1f00-\u1fff", "han": "\u3400-\u4dbf\u4e00-\u9fff", "arabic": "\u0600-\u06ff",
    "hebrew": "\u0590-\u05ff", "kana": "\u3040-\u30ff", "hangul": "\uac00-\ud7af", "devanagari": "\u0900-\u097f", "thai": "\u0e00-\u0e7f",
}
_SCRIPT_OF = {script: re.compile(f"[{letters}]") for script, letters in _SCRIPTS.items()}


def script_of(text: str) -> str:
    return next((script for script, letters in _SCRIPT_OF.items() if letters.search(text)), "latin")


def _name(value: str, gender: str, attempt: int, draw: _Draw) -> str:
    script, words = script_of(value), value.split(" ")
    if script in LETTERS:
        letters = LETTERS[script][1]
        return " ".join("".join(letters[draw.below(len(letters))] for _ in range(max(2, len(w)) + attempt // 3)) for w in words)
    genders = [gender] if gender else ["f", "m"]
    given = [n for g in genders for n in GIVEN[script, g].split()]
    family = FAMILY[script].split()

    def surname() -> str:
        if attempt > 2:
            # The lists are used up: made names follow.
            return "".join(SYLLABLES[script][draw.below(10)] for _ in range(2 + attempt // 3)).capitalize()
        return family[draw.below(len(family))]

    if script == "han" and len(words) == 1:
        # The family comes first, and no space between.
        return surname() + "".join(given[draw.below(len(given))] for _ in value[1:3])
    out = [given[draw.below(len(given))]] if len(words) > 1 or gender == "" else []
    while len(out) < len(words):
        part = words[len(out)]
        out.append(part if part in PARTICLES else surname())
    return " ".join(out[: len(words)])


def surrogate(kind: str, value: str, gender: str, attempt: int, key: bytes = b"") -> str:
    """The surrogate of a canonical value, in canonical form (names capitalised)."""
    draw = _Draw(key, kind, value, gender, attempt)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ip6":
        return ipaddress.IPv6Address(":".join(f"{1 + draw.below(65535):04x}" for _ in range(8))).exploded
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else string.ascii_uppercase[draw.below(26)] for c in value[4:])
        return f"{value[:2]}{98 - checked(value[:2] + '00' + body):02d}{body}"
    if kind in ("phone", "ssn", "card"):
        if kind == "card":
            body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
            check = luhn(body + "0")
            # A number that fails the check gets one that fails it too.
            return body + str(check if luhn(value) == 0 else (check + 1 + draw.below(9)) % 10)
        keep = 1 if kind == "phone" and len(value) > 10 else 0
        return value[:keep] + "".join(str(draw.below(10)) for _ in value[keep:])
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        # The domain's surrogate depends on the domain alone, and the last label stays.
        of_domain = _Draw(key, "domain", ".".join(labels[:-1]))
        inner = ["".join(_like(c, of_domain) for c in label) for label in labels[:-1]]
        # An address too short for one of its own grows.
        more = string.ascii_lowercase[draw.below(26)] * (attempt > 5) + str(attempt) * (attempt > 5)
        return "".join(_like(c, draw) for c in local) + more + "@" + ".".join([*inner, labels[-1]])
    return _name(value, gender, attempt, draw)


def _like(c: str, draw: _Draw) -> str:
    if c in string.ascii_lowercase:
        return string.ascii_lowercase[draw.below(26)]
    return str(draw.below(10)) if c.isdigit() else c


def rendered(kind: str, found: str, replacement: str) -> str:
    """The surrogate in the form in which the entity was written."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(replacement)
        return "".join(next(digits) if c.isdigit() else c for c in found)
    if kind == "iban":
        signs = iter(replacement)
        return "".join(c if c == " " else next(signs) for c in found)
    if kind == "ip6":
        return replacement.upper() if found.isupper() else replacement
    if kind == "name":
        # A surname alone stands for a full name.
        replacement = " ".join(replacement.split(" ")[-len(found.split(" ")) :])
    if kind == "email" and len(found) == len(replacement):
        return "".join(n.upper() if o.isupper() else n for o, n in zip(found, replacement))
    if kind == "name" and found.isupper() and len(found) > 1:
        return replacement.upper()
    return replacement


_SPANS = "array<struct<start:int,end:int,kind:string,gender:string,value:string>>"


def _spans_of(texts: pa.Array) -> list[list[dict]]:
    out = []
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        out.append(
            [
                {"start": a, "end": b, "kind": k, "gender": g, "value": v} for a, b, k, g, v in _entities(text)
            ]
        )
    return out


def _detected(with_entities: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct(
                [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("gender", pa.string()), ("value", pa.string())]
            )
        )
        for batch in batches:
            spans = _spans_of(batch.column("text"))
            keep = pa.array([bool(s) == with_entities for s in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(spans, kind)], ["doc_id", "text", "spans"]
            ).filter(keep)

    return run


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "gender", "attempt")))
            made = [surrogate(k, v, g, a, key) for k, v, g, a in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("kind", "value", "gender", "attempt")), pa.array(made, pa.string())],
                ["kind", "value", "gender", "attempt", "surrogate"],
            )

    return run


def key_of(spark: SparkSession) -> bytes:
    """The key of the session's setting, or one drawn for this application that nobody knows."""
    setting = spark.conf.get(KEY_SETTING, None)
    if setting:
        return setting.encode()
    return _keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


_keys: dict[str, bytes] = {}


def assigned(entities: DataFrame, key: bytes = b"") -> DataFrame:
    """entities (kind, value, gender), one row each -> with a surrogate that no other entity has.

    Of entities that draw the same surrogate the smallest value keeps it; one that draws a
    value of the data, its own included, draws again as well.
    """
    schema = "kind string, value string, gender string, attempt int, surrogate string"
    values = entities.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    open_ = entities.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    while True:
        drawn = open_.select("kind", "value", "gender", "attempt").mapInArrow(_drawn(key), schema)
        drawn = written(drawn.withColumn("form", F.lower("surrogate")), "drawn")
        # A surrogate that was settled before stays with its entity.
        if settled is not None:
            taken = settled.select(F.col("kind").alias("k"), F.col("form").alias("v"))
        else:
            taken = values.where("false")
        first = drawn.groupBy("kind", "form").agg(F.min("value").alias("value"))
        fresh = first.join(
            values.union(taken), (F.col("kind") == F.col("k")) & (F.col("form") == F.col("v")), "left_anti"
        )
        marked = written(
            drawn.join(fresh.withColumn("ok", F.lit(True)), ["kind", "form", "value"], "left"), "marked"
        )
        won = marked.where("ok").select(*drawn.columns)
        settled = written(won if settled is None else settled.union(won), "settled")
        open_ = marked.where("ok is null").withColumn("attempt", F.col("attempt") + 1)
        if open_.isEmpty():
            return settled.select("kind", "value", "surrogate")


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            pieces, at = [], 0
            for span in sorted(found, key=lambda s: s["start"]):
                pieces += [
                    text[at : span["start"]],
                    rendered(span["kind"], text[span["start"] : span["end"]], span["surrogate"]),
                ]
                at = span["end"]
            out.append("".join([*pieces, text[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out, pa.string()), pa.array([len(f) for f in batch.column("found").to_pylist()], pa.int64())],
            ["doc_id", "text", "n_entities"],
        )


def surrogates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None
) -> DataFrame:
    """(doc_id, text, n_entities) for every row of documents, entities replaced.

    The key is the caller's secret: who knows it can try out which value a surrogate stands for. Runs with the same key, given
    or set as KEY_SETTING, give the same surrogates; otherwise they hold within an application. A very long text is searched whole,
    in its row. A null text stays null, a text without entities stays as it is (n_entities 0). Ids may be null
    or repeat. Equal entities get equal surrogates and different ones different surrogates, over the
    whole table. An empty table gives an empty result. Other columns are not looked at.
    """
    key = key or key_of(prepared(documents.sparkSession))
    docs = narrow(documents, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, text string, spans {_SPANS}"
    bare = docs.mapInArrow(_detected(False), schema).select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_entities")
    )
    # The row numbers are written with the rows, so they do not change when a task is repeated.
    full = written(
        docs.mapInArrow(_detected(True), schema).withColumn("row", F.monotonically_increasing_id()), "entities"
    )
    spans = full.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    # One person may be met with and without a gender: the known one counts.
    entities = written(spans.groupBy("kind", "value").agg(F.max("gender").alias("gender")), "known")
    named = (
        spans.join(assigned(entities, key), ["kind", "value"])
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "end", "kind", "surrogate")).alias("found"))
    )
    changed = full.select("row", "doc_id", "text").join(named, "row")
    return bare.union(
        changed.select("doc_id", "text", "found").mapInArrow(_replaced, "doc_id long, text string, n_entities long")
    )
