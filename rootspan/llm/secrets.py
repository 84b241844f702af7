"""Secret scans: fixed shapes, and tokens that two Markov models call random.

Base kinds are found by pattern: ``assign`` (a credential word, a separator and a value), ``access``
(AKIA keys) and ``hex`` (long lower-case hex runs). The method adds ``random``: tokens of 16 characters or
more, with a letter among them, whose log-likelihood under a first-order character model of random strings
exceeds that under a model of ordinary identifiers by ``threshold``. A token is judged by itself, whether a
base span covers it or not: on a base span it says that the value looks drawn by chance. Both models are
trained from labelled samples, ``training_samples()`` unless others are given: random strings are digests
written in usual alphabets; ordinary ones are the names of Python's standard library (``MODULES``) and
identifiers and paths made of words.

Plan. Everything is one projection over the scan: no shuffle, no Python. A pattern runs to the end only
on texts that a first search accepts. Positions come from running sums (``spans.py``), a token's characters
are taken apart once. The table of log-ratios is a constant array of (symbols x symbols) doubles inside the
expression.

Defined results: null text counts as empty and has no spans; spans are in code points, end exclusive;
repeated rows are scanned each by itself; other columns pass through untouched, and where one is called
``base`` or ``spans`` already the new one gets an underscore after its name.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.llm.spans import let, matches
from rootspan.llm.tasks import fresh

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
THRESHOLD = 12.0
KINDS = ("assign", "access", "hex", "random")
#: Modules whose names are ordinary identifiers.
MODULES = """argparse array ast asyncio base64 bisect calendar codecs collections configparser contextlib copy csv ctypes datetime decimal
difflib dis email email.message enum fileinput fractions ftplib functools gettext glob gzip hashlib heapq html http.client http.server
imaplib inspect io ipaddress itertools json keyword linecache locale logging logging.handlers mailbox math mimetypes multiprocessing
numbers operator os pathlib pickle platform pprint queue random re sched selectors shelve shutil signal smtplib socket socketserver
sqlite3 ssl stat statistics string struct subprocess tarfile tempfile textwrap threading timeit token tokenize traceback types typing
unittest unittest.mock urllib.parse urllib.request uuid warnings weakref xml.dom.minidom xml.etree.ElementTree zipfile""".split()

WORDS = """the and with from this that have value index count token user name path file data node list item type
state query table column row key map set get put make build load store read write open close start stop
begin end first last next previous parent child left right update delete insert select filter group order
config option default session cache buffer stream channel message request response client server handler
manager factory service provider controller model view action event listener error exception result status
version number string integer double float boolean array object class function method module package import
export public private static final abstract interface message directory folder image color width height
length offset position element attribute document section paragraph language license transaction information
international administration communication responsibility understanding straightforward organization
nation thing other there where when which would could should these those after before under about between
und der die das nicht eine werden verfahren zeitung freiheit keit schaft les des une dans pour avec sont
nous vous etre mention tion ement para como pero entre desde hasta ciones mente""".split()


@lru_cache(maxsize=4)
def library_names(modules: tuple[str, ...]) -> list[str]:
    """Names in the modules and in their classes, sorted."""
    found = set()
    for name in modules:
        try:
            module = importlib.import_module(name)
        except ImportError:  # left out of this build of Python
            continue
        found.update(dir(module))
        for x in vars(module).values():
            if isinstance(x, type):
                found.update(f"{x.__name__}_{y}" for y in dir(x))
    return sorted(x for x in found if len(x) >= 8 and set(x) <= set(ALPHABET))


def training_samples(each: int = 6000, modules: tuple[str, ...] = tuple(MODULES)) -> list[tuple[int, str]]:
    """(1, random string) and (0, ordinary identifier), ``each`` of both, the same at every call.

    Half of the ordinary ones are library names, evenly taken, alone or joined; half are words in usual shapes.
    """
    samples: list[tuple[int, str]] = []
    n, names = len(WORDS), library_names(tuple(modules))
    for i in range(each):
        d = hashlib.sha512(b"%d" % i).digest()
        forms = (
            d[:20].hex(),
            d[:20].hex().upper(),
            base64.b64encode(d[:30]).decode(),
            base64.urlsafe_b64encode(d[:30]).decode(),
            base64.b32encode(d[:25]).decode(),
            "".join(ALPHABET[x % 62] for x in d[:32]),
            "AKIA" + "".join(ALPHABET[26 + x % 36] for x in d[:16]),
            "".join(ALPHABET[26 + x % 36].lower() for x in d[:32]),
        )
        samples.append((1, forms[i % len(forms)]))
        w = [WORDS[(d[40 + k] * 256 + d[50 + k]) % n] for k in range(2 + d[63] % 4)]
        shapes = (
            "_".join(w), w[0] + "".join(x.capitalize() for x in w[1:]), "-".join(w), "/".join(w), "".join(w),
            "_".join(w).upper(), "".join(x.capitalize() for x in w), "".join(w) + "=" * (d[62] % 3), "-" * 8 + w[0] + "_" * 8, w[0] + str(d[61] % 100) + "_" + "_".join(w[1:]),
        )
        pick = lambda k: names[(i * 2654435761 + k * 40503) % len(names)]  # noqa: B023, E731
        samples.append((0, shapes[i // 2 % len(shapes)] if i % 2 or not names else (pick(0), f"{pick(0)}/{pick(1)}", f"{pick(0)}-{pick(1)}")[i // 2 % 3]))
    return samples


def train(samples: list[tuple[int, str]], smooth: float = 0.5) -> list[float]:
    """Log-ratios of transition probabilities, random over ordinary, row by row over ALPHABET."""
    at, size = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    counts = [[[smooth] * size for _ in range(size)] for _ in range(2)]
    for label, token in samples:
        known = [at[c] for c in token if c in at]
        for a, b in zip(known, known[1:]):
            counts[label][a][b] += 1
    share = [[[x / sum(row) for x in row] for row in model] for model in counts]
    return [round(math.log(share[1][a][b] / share[0][a][b]), 4) for a in range(size) for b in range(size)]


def spans_of(text: Column, pattern: str, kind: int, keep_group: tuple[int, int] | None = None) -> Column:
    """array<struct<start, kind, end, body>> of the matches; keep_group: (group, least length)."""
    rx = F.lit(pattern)

    def row(i: Column, start: Column, end: Column, body: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), body.alias("body"))

    found = matches(text, rx, row)
    if keep_group:
        sizes = F.transform(F.regexp_extract_all(text, rx, F.lit(keep_group[0])), F.length)
        both = F.struct(found.alias("spans"), sizes.alias("sizes"))
        found = let(both, lambda b: F.filter(b["spans"], lambda s, i: F.get(b["sizes"], i) >= keep_group[1]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,body:string>>"))


def log_ratio(token: Column, table: list[float]) -> Column:
    """Sum of the log-ratios of a token's transitions."""
    size = len(ALPHABET)
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    step = lambda x, i: F.get(ratios, F.get(x, i - 1) * size + F.get(x, i))
    total = lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda acc, i: acc + step(x, i))
    return let(codes, lambda x: F.when(F.size(x) > 1, total(x)).otherwise(0.0))


def scan(docs: DataFrame, text: str = "text", samples: list[tuple[int, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: array<struct<start, kind, end, body>> by start, then kind."""
    table = train(samples or training_samples())
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.array_sort(F.concat(spans_of(whole, ASSIGN, 0, (2, 6)), spans_of(whole, ACCESS, 1), spans_of(whole, HEX, 2)))
    tokens = F.filter(spans_of(whole, TOKEN, 3), lambda s: s["body"].rlike("[A-Za-z]") & (log_ratio(s["body"], table) >= threshold))
    own, every = fresh("base", docs.columns), fresh("spans", docs.columns)
    found = docs.select(*[F.col(f"`{c}`") for c in docs.columns], base.alias(own), tokens.alias(fresh("tokens", [*docs.columns, own, every])))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(own), F.array_sort(F.concat(F.col(own), F.col(found.columns[-1]))).alias(every))


def _digest(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
    )
