"""Credentials in source code, configuration and notes, and texts with them removed.

1. Literals with the structure of a secret that stand where one would (a secret's
   name before it, a known token format, user info of a URL, a header, an option,
   a call, a sentence) are taken out with their place.
2. An index of the whole corpus, one entry per text and run of letters and digits,
   tells in which texts such a value may stand, whatever is around it there.
   These texts are scanned with an automaton of just these values, so no task
   and no driver ever holds all values, and the corpus is read once for them.
3. A value that many different owners hold is a placeholder that people share, and
   is suppressed; all places of the others are confirmed.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.runtime import Stage

#: Names of secrets, and formats of well-known tokens.
_NAME = r"passw(?:or)?[dt]|kennwort|contrase[nñ]a|passphrase|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|encryption[_ -]?key|signing[_ -]?key|auth[_ -]?key|credential|bearer|passcode|smtp[_-]?pass|(?<![a-z])pass(?![a-z])"
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|xox[abeoprs]-[0-9A-Za-z-]{16,}|[srp]k_(?:live|test)_[0-9A-Za-z]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20}|npm_[0-9A-Za-z]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|whsec_[A-Za-z0-9+/=]{16,}|sk-(?:ant-|proj-)?[A-Za-z0-9_-]{24,}|shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}|dop_v1_[0-9a-f]{64}|ya29\.[\w-]{20,}|sq0(?:csp|atp)-[\w-]{22,}|pypi-[\w-]{40,}|dckr_pat_[\w-]{20,}|lin_api_[A-Za-z0-9]{32,}|xapp-[0-9A-Za-z-]{16,}|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{16,})"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"[a-z][a-z0-9+.-]*://[^\s:/@\"'`<>{}]*:([^\s/@\"'`]+)@[\w.-]", re.I)
_HEADER = re.compile(r"\b(?:Basic|Bearer|Token)\s+([A-Za-z0-9+/=._~-]{12,})")
_OPTION = re.compile(rf"(?:--?[\w-]*(?:{_NAME})[\w-]*|[?&;][\w.-]*(?:{_NAME}|key|auth|sig)[\w.-]*|\b(?:{_NAME}|Pwd))(?:=|\s+(?=['\"]?[^\s=-]*\d))['\"]?([^\s\"'`&;,<>]+)", re.I)
_ASSIGN = re.compile(
    rf"([\w.$-]*(?:{_NAME})[\w-]*)[\"'`\]]*\s*(?:\[\s*\]\s*)?(?::\s*(?:&(?:'?\w+\s+)?|Option<|\[\]|\*)*\w[\w<>\[\]]*\s*=(?![=>])|:=|=>|=(?!=)|:)\s*", re.I
)
_DEFINE = re.compile(rf"\s*#\s*define\s+(\w*(?:{_NAME})\w*)\s+(?=\S)", re.I)
_SETTING = re.compile(r"\s*(?:(?:export|set|ENV|ARG)\s+|[-*#]\s+|//\s*)?[\w.-]*$")
_CHECKSUM = re.compile(r"sha\d+$|md5$|checksum$|hash$|digest$|icon$", re.I)
_CALL = re.compile(r"\b\w*(?:log_?in|sign_?in|authenticate|authorize|connect|credential|password|passwd|auth)\w*\s*\(", re.I)
#: A secret's name as a word of a sentence, and what a sentence may call one: a quoted literal without blanks, or the word behind a verb.
_WORD = re.compile(rf"(?<![\w.$/-])(?:{_NAME}|key)s?(?![\w=(\[./-]|\s*[=:])(?![\w ]*\b(?:path|field|name|pattern|template|url|icon)\b)", re.I)
_CALLED = re.compile(r"[`\"']([^`\"'\s]+)[`\"']|\b(?:was|is|are|equals?)\s+([^\s`\"',]+)", re.I)
_QUOTED = re.compile(r"\"((?:[^\"\\]++|\\.)*+)\"|'((?:[^'\\]++|\\.)*+)'|`([^`]*+)`")
_BODY = re.compile(r"(?:\s*(?:\"\"|''|[|>][+-]?|\(|\\|\+|\.|[\w.:!]+\(|(?:b|r|u|f|L)(?=[\"'])|&)\s*)*")
_MORE = re.compile(r"(?:\s*\\?\s*[+,.]?\s*\\?\s*)(?=[\"'`])")
_KEYED = re.compile(r"\s*[:=]")
_BARE = re.compile(r"[^\s\"'`;,#][^\s\"'`;,]*")
_LINE_ENDS = re.compile(r"\s*(?:[;,]\s*)?(?:#.*)?(?:\n|\Z)")
#: Names of passwords, behind which short values and values with blanks count too; words of prompts and messages.
_PASSWORD = re.compile(r"(?:passw(?:or)?[dt]|kennwort|contrase[nñ]a|passphrase|passwd|pwd|passcode)$", re.I)
#: Options of common tools whose value is or ends in a password.
_LOGIN_OPTION = re.compile(r"(?<!\S)(?:-u\s?|--(?:proxy-)?user[=\s]\s*)[\"']?[^\s:\"'`]+:([^\s\"'`]+)|\b(?:sshpass\s+-p\s*|mysql(?:dump|admin)?\b[^|;\n]*?\s-p(?=\S))[\"']?([^\s\"'`]+)")
_QUOTED_OPTION = re.compile(r"--?[\w-]*(?:password|passphrase|passwd|pwd|passcode)(?:=|\s+)([\"'])((?:(?!\1)[^\n])+ (?:(?!\1)[^\n])+)\1", re.I)
_MESSAGE = re.compile(
    r"(?i)\b(?:passw(?:or)?ds?|passphrases?|passwd|pwd|secret|token|key|credentials?|login|enter|type|please|your|must|is|are|be|was|the|required?|invalid|wrong|incorrect|missing|empty|confirm|forgot(?:ten)?|reset|change|repeat|minimum|maximum|characters?|least|not|should|cannot|can|if|from|select|where|and|or|none|null|error|failed)\b|[?:…]$"
)
_NOT_A_SECRET = re.compile(r"(?:path|field|name|file|pattern|regex|template|url|uri|icon|sha256|sha1|md5|checksum|hash|digest|length|len|count|size|ttl|type|label|header|hint|prompt|policy|store|manager|provider|factory|service|count|limit|index|kind|expiry|at)$", re.I)
_LOOKED_UP = re.compile(r"env|lookup|vault|read|load|fetch|getProperty|config|secrets?\.|\bget\(|prompt|input|ask|file|open\(", re.I)
_PLACEHOLDER = re.compile(
    r"<[\w .-]+>|\{[\w. -]*\}|\[[^\]]+\][{*+?]?|\(.*\|.*\)|\[\^|^\$[\w{(]|^%[\w(]+%?$|\$\{|\{\{|^x{3,}$|^[.*x-]+$|change[_-]?me|replace[_-]?me|your[_-]|placeholder|dummy|sample|redacted|^todo|^fixme|^none$|^null$|^true$|^false$|^undefined$|not[_-]?set|^test$|^example|^insert|\.\.\.|^https?://|^data:|/secrets?/|^projects/", re.I
)
#: Lower-case parts of which every match of a rule holds one (the shortest literal of each); the known formats need no line of their own.
_PARTS = "pass kennwort contrase pwd secret token key credential bearer auth sig basic login log_in connect :// mysql --user --proxy-user".split() + ["-u"]
#: Letters that a pattern without regard to case takes for ``s`` or ``i`` although their lower case is another.
_FOLDED = {"\u017f": "s", "\u0131": "i", "\u0130": "i"}
_FORMATS = "akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ xox sk_live_ sk_test_ pk_live_ pk_test_ rk_live_ rk_test_ aiza glpat- npm_ sg. hf_ whsec_ sk- shpat_ shpss_ shpca_ shppa_ dop_v1_ ya29. sq0 pypi- dckr_pat_ lin_api_ xapp- eyj".split()
ROWS = "tab string, id string, owner string, doc long, line_no long, start long, stop long, value string, rule string"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


@lru_cache(maxsize=1)
def _hints() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for w in _PARTS:
        machine.add_word(w, w)
    machine.make_automaton()
    return machine


def structured(value: str, named: bool = False) -> bool:
    """Does ``value`` look like a secret and not like a word, a path, a template or a number?"""
    if len(value) < 8 or re.search(r"\s", value) or not _looks_random(value) and _PLACEHOLDER.search(value):
        return False
    if re.fullmatch(r"[\d.,:/_-]+", value) or re.fullmatch(r"\w+(?:\.\w+)*\(.*", value):
        return False
    letters, digits, marks = bool(re.search(r"[A-Za-z]", value)), bool(re.search(r"\d", value)), bool(re.search(r"[^\w/.-]", value))
    if re.fullmatch(r"[a-z]+(?:[_.-][a-z]+)*|[A-Z]+(?:_[A-Z0-9]+)*|[A-Za-z]+(?:[.][A-Za-z]+)*", value):
        return named and len(value) >= 16 and bool(re.search(r"[a-z][A-Z].*[A-Z][a-z]*[A-Z]", value)) and not re.fullmatch(r"[A-Z]?[a-z]{3,}(?:[A-Z][a-z]{3,})*", value)
    if re.fullmatch(r"(?:\./|/|~/)?[\w-]+(?:/[\w.-]+)+", value) and not (digits and re.search(r"[A-Z]", value) and re.search(r"[a-z]", value)):
        return False
    return letters and (digits or marks or _looks_random(value))


def _looks_random(value: str) -> bool:
    return len(value) >= 20 and len(set(value)) >= 12 and bool(re.search(r"\d", value)) and bool(re.search(r"[a-z]", value)) and bool(re.search(r"[A-Z]", value)) and re.fullmatch(r"[\w+/=-]+", value) is not None


def _password(name: str, value: str) -> bool:
    """Is ``value``, behind the name of a password, a short password or a passphrase of several words?"""
    if not _PASSWORD.search(name) or _PLACEHOLDER.search(value):
        return False
    if " " in value:
        words = value.split(" ")
        joined = re.search(r"[\"'`]\s*[+.,&]|[+.,&]\s*[\"'`]|^[\"'`]|[\"'`]$", value)
        return all(words) and value.isprintable() and not joined and not _MESSAGE.search(value) and bool(re.search(r"[^\W_]", value))
    return len(value) < 8 and bool(re.search(r"[A-Za-z]", value)) and bool(re.search(r"[\d!@#$%^&*?+=~]", value)) and not re.search(r"[\s()\[\]<>{}]", value)


def _wrapped(value: str) -> bool:
    """Encoded data that was cut into lines."""
    rows = value.split()
    return "\n" in value and len(rows) > 1 and all(re.fullmatch(r"[\w+/=-]{16,}", x) for x in rows[:-1]) and _looks_random("".join(rows))


def _decodes(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def find(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, stop, value, rule)`` of the secrets in one text, in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    for m in PEM.finditer(text):
        stop = _pem_end(text, m.end())
        after = re.sub(r"\\n|[\"'`+\s,.()\\]|concat!|#|//|\|", "", text[m.end() : stop])
        if re.match(r"[A-Za-z0-9+/=]{24,}|Proc-Type|Version", after):
            found.append((m.start(), stop, m.group(), "pem"))
    for m in KNOWN.finditer(text):
        found.append((m.start(), m.end(), m.group(), "format"))
    done = -1
    low = (text if text.isascii() else text.translate(str.maketrans(_FOLDED))).lower()
    if len(low) != len(text):  # some letters grow in lower case; then no place can be told from it
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for end, _ in _hints().iter(low):  # only lines on which any rule could begin
        if end <= done:
            continue
        at = text.rfind("\n", 0, end) + 1
        done = text.find("\n", end)
        done = len(text) if done < 0 else done
        line = text[at:done]
        found += [(at + x, at + y, v, r) for x, y, v, r in _in_line(line)]
        if _ASSIGN.search(line) or _DEFINE.match(line):
            found += _assigned(text, at, line)
    found.sort()
    out: list[tuple[int, int, str, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def _pem_end(text: str, at: int) -> int:
    m = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----").search(text, at)
    return m.end() if m else len(text)


def _in_line(line: str) -> list[tuple[int, int, str, str]]:
    out = []
    for m in _URL.finditer(line):
        v = m[1]
        if len(v) >= 4 and not _PLACEHOLDER.search(v) and not re.fullmatch(r"(?i)pass(?:word)?|pwd|secret|xxx+|\*+", v):
            out.append((m.start(1), m.end(1), v, "url"))
    for m in _HEADER.finditer(line):
        v = m[1]
        if not _PLACEHOLDER.search(v) and (_decodes(v) if "Basic" in m.group() else structured(v)):
            out.append((m.start(1), m.end(1), v, "header"))
    for m in _OPTION.finditer(line):
        name = re.split(r"[=\s]", m.group(), maxsplit=1)[0]
        v = m[1].rstrip(").]")
        if not _NOT_A_SECRET.search(name) and (structured(v, True) or _password(name, v)) and not re.match(r"[\w.]+[(\[]", v) and (m.group()[0] in "-?&;" or _password_like(v)):
            out.append((m.start(1), m.start(1) + len(v), v, "option"))
    for m in _LOGIN_OPTION.finditer(line):
        k = 1 if m[1] else 2
        v = m[k].rstrip(").],;")
        if (structured(v, True) or _password("password", v)) and not re.match(r"[\w.]+[(\[]|//|\\", v):
            out.append((m.start(k), m.start(k) + len(v), v, "option"))
    for m in _QUOTED_OPTION.finditer(line):
        if _password("password", m[2]):
            out.append((m.start(2), m.end(2), m[2], "option"))
    if _WORD.search(line):
        for m in _CALLED.finditer(line):
            k = 1 if m[1] else 2
            v = m[2].rstrip(".;:!)") if k == 2 and m[2][-1:] in ".;:)" else m[k]
            if structured(v, True) and _password_like(v) and re.search(r"\d", v) and not re.search(r"^[\w./-]+\.\w{1,5}$|^[A-Za-z]+[_-]?\d+$|[(\[{<]", v):
                out.append((m.start(k), m.start(k) + len(v), v, "prose"))
    c = _CALL.search(line)
    if c and not _LOOKED_UP.search(c.group()):
        literals = [(q, next(g for g in q.groups() if g is not None)) for q in _QUOTED.finditer(line, c.end())]
        for q, v in literals:
            before = line[c.end() : q.start()]
            if re.search(r"(?i)\b(?:user(?:name)?|login|host|url|name|id)\s*[:=]\s*$", before):
                continue
            if structured(v, True) and _password_like(v) and not re.match(r"\w+://", v):
                out.append((q.start() + 1, q.end() - 1, v, "call"))
    return out


def _password_like(v: str) -> bool:
    """Letters with digits or marks, not an ordinary identifier with a number at its end."""
    return bool(re.search(r"[A-Za-z]", v)) and (bool(re.search(r"\d", v)) or bool(re.search(r"[^\w.-]", v)) or _looks_random(v)) and not re.fullmatch(r"[a-z]+(?:_[a-z0-9]+)*|[A-Z]+(?:_[A-Z0-9]+)*", v)


def _assigned(text: str, at: int, line: str) -> list[tuple[int, int, str, str]]:
    out = []
    for m in [*_ASSIGN.finditer(line), *_DEFINE.finditer(line)]:
        name = m[1]
        other = bool(_NOT_A_SECRET.search(name))
        if other and _CHECKSUM.search(name):
            continue
        start = at + m.end()
        end = text.find("\n", start)
        first = text[start : len(text) if end < 0 else end]
        wrapper = re.match(r"[\w.:!&\s\[\]<>]*\(?\s*", first).group() if not first[:1] in "\"'`" else ""
        if _LOOKED_UP.search(wrapper) and re.search(r"[(\[.]\s*$|^(?:process|os|std|import\.meta)\b.*env", first[: len(wrapper) + 1]):
            continue
        body = _BODY.match(text, start).group()
        here = start + len(body)
        q = _QUOTED.match(text, here)
        if q:
            v = next(g for g in q.groups() if g is not None)
            pieces, stop = [v], q.end()
            while (more := _MORE.match(text, stop)) and ("\n" in more.group() or "+" in more.group() or "," in more.group() and "concat" in body or more.group().isspace()):
                nxt = _QUOTED.match(text, more.end())
                if not nxt or _KEYED.match(text, nxt.end()):
                    break
                pieces.append(next(g for g in nxt.groups() if g is not None))
                stop = nxt.end()
            value = "".join(pieces)
            if PEM.search(value) or KNOWN.search(v):
                continue
            fits = structured(value, True) and _value_fits(name, value) and (not other or _looks_random(value))
            if fits or not other and (_password(name, value) or _wrapped(value)):
                out.append((here + 1, stop - 1, value, "assigned"))
            continue
        bare = _BARE.match(text, here)
        own_line = _SETTING.match(line[: m.start(1)]) and _LINE_ENDS.match(text, bare.end()) if bare else None
        if own_line and not other and text[here] not in ":[(=|>&*!" and ("\n" not in body or "|" in body or ">" in body) and not wrapper.strip().endswith("("):
            v = bare.group()
            plain = re.match(r"[\w.:]+[(\[]", v) or re.fullmatch(r"[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+|[A-Za-z_]+\d{0,2}", v)
            if not plain and (structured(v, True) and _value_fits(name, v) or _password(name, v)):
                out.append((here, here + len(v), v, "assigned"))
        elif bare and not own_line and not other and re.search(r"passphrase$", name, re.I) and re.fullmatch(r"\s*(?:(?:export|set|ENV|ARG)\s+|-\s+)?[\w.-]*", line[: m.start(1)]) and first.count(" ") > 1:
            v = first.strip()
            if not body and re.fullmatch(r"[\w!@#$%^&*?+~-]+(?: [\w!@#$%^&*?+~-]+)+", v) and _password(name, v):
                out.append((here, here + len(v), v, "assigned"))
    return out


def _value_fits(name: str, value: str) -> bool:
    """Ordinary words that merely stand behind a name with ``token`` in it are no secrets."""
    return _password_like(value) or _looks_random(value)


def _texts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``tab, id, owner, doc, content`` of both tables; ``doc`` is equal for repeated rows only."""
    a = chunks.select(F.lit("chunk_doc").alias("tab"), "id", F.coalesce("repo", F.lit("")).alias("owner"), "content")
    b = vectors.select(F.lit("vector_doc").alias("tab"), "id", F.coalesce(F.get_json_object("metadata", "$.codebasePath"), F.lit("")).alias("owner"), "content")
    both = a.unionByName(b).where("id is not null and content is not null")
    return both.select("tab", "id", "owner", F.xxhash64("tab", "id", "content").alias("doc"), "content")


def _place(text: str, start: int) -> int:
    return text.count("\n", 0, start) + 1


def candidates(texts: DataFrame) -> DataFrame:
    """All literals of ``texts`` that stand where a secret would, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tab, i, owner, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(tab, i, owner, doc, _place(text, a), a, b, v, r) for a, b, v, r in find(text)]
            if out:
                yield _batch(out)

    low = F.lower("content")  # substring tests in the JVM are far cheaper than one large pattern
    some = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in [*_PARTS, *_FORMATS, "private key"]))
    some = reduce(lambda a, b: a | b, (F.contains("content", F.lit(c)) for c in _FOLDED), some)
    return texts.where(some).select("tab", "id", "owner", "doc", "content").mapInArrow(run, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 3 + [pa.int64()] * 4 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def _runs(text: Column) -> Column:
    """The runs of letters and digits of a text."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def index(texts: DataFrame) -> DataFrame:
    """``texts`` with ``run``: a hash of every run of letters and digits of every text, once per text."""
    each = texts.withColumn("run", F.explode(F.array_distinct(_runs(F.col("content")))))
    return each.withColumn("run", F.xxhash64("run"))


def holders(texts: DataFrame, values: DataFrame, stage: Stage, broadcast_values: int) -> DataFrame:
    """``texts`` with ``value``: every pair in which the value is a part of the text, rows of one text in sequence.

    Pairs are found by one run of the value that is also one of the text's, if
    possible one with a digit, which few texts share. Up to ``broadcast_values``
    values are broadcast and compared while the texts are read; more are shuffled
    with the index, where adaptive execution splits the partition of a frequent run.
    """
    telling = F.transform(_runs(F.col("value")), lambda x: F.struct((x.rlike("[0-9]") & (F.length(x) > 2)).alias("digit"), F.length(x).alias("n"), x.alias("x")))
    keyed = values.select("value", F.xxhash64(F.array_max(telling)["x"]).alias("run"))
    if values.count() <= broadcast_values:
        pairs = index(texts).join(F.broadcast(keyed), "run")
    else:
        wanted = stage.save(index(texts.select("doc", "content")).join(keyed, "run").select("doc", "value")).distinct()
        pairs = texts.join(wanted, "doc")
    return pairs.where(F.contains("content", F.col("value"))).select("tab", "id", "owner", "doc", "content", "value")


def detect(chunks: DataFrame, vectors: DataFrame, owners_at_most: int = 8, broadcast_values: int = 500_000) -> DataFrame:
    """``tab, id, owner, doc, line_no, start, stop, value, rule``: each place of a confirmed secret, once per distinct row.

    A value that more than ``owners_at_most`` repositories hold, in whatever
    context, is a shared placeholder. Null contents give no rows.
    """
    stage = Stage(chunks.sparkSession, "secrets")
    texts = _texts(chunks, vectors)
    first = stage.save(candidates(texts))
    values = stage.save(first.where("rule != 'pem'").select("value").distinct())
    again = stage.save(holders(texts, values, stage, broadcast_values).mapInArrow(_scan, ROWS))
    every = first.unionByName(again)
    shared = every.where("rule != 'pem'").groupBy("value").agg(F.countDistinct("owner").alias("owners")).where(F.col("owners") > owners_at_most)
    kept = every.join(shared, "value", "left_anti")
    merged = kept.groupBy("tab", "id", "doc", "line_no", "start").agg(F.max_by(F.struct("owner", "stop", "value", "rule"), F.struct("stop", "rule")).alias("x"))
    return merged.select("tab", "id", "x.owner", "doc", "line_no", "start", "x.stop", "x.value", "x.rule")


def _stands_alone(text: str, a: int, b: int, value: str) -> bool:
    """Is ``value`` at ``a:b`` no part of a longer token?

    A value under 12 characters must be a whole token; one that might be an
    ordinary word (a URL's password may be any) must stand in quotes.
    """
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    if before.isalnum() and value[0].isalnum() or after.isalnum() and value[-1].isalnum():
        return False
    if len(value) >= 12 or before and before == after and before in "\"'`":
        return True
    part = re.compile(r"[\w.$/+-]")
    end = text[b : b + 2]
    ends = not part.match(after) or re.match(r"\.(?:\s|$)", end) is not None or end == "."
    return structured(value, True) and _password_like(value) and not part.match(before) and ends


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the values that stand behind a text, by an automaton per text; rows of one text follow each other."""
    text: tuple | None = None
    words: list[str] = []
    for batch in batches:
        out: list[tuple] = []
        for *row, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text != tuple(row):
                out += _occurrences(text, words)
                text, words = tuple(row), []
            words.append(value)
        if out:
            yield _batch(out)
    out = _occurrences(text, words)
    if out:
        yield _batch(out)


def _occurrences(row: tuple | None, words: list[str]) -> list[tuple]:
    if row is None:
        return []
    tab, i, owner, doc, text = row
    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, w)
    machine.make_automaton()
    out, last = [], 0
    places = ((end + 1 - len(w), end + 1, w) for end, w in machine.iter(text))
    for a, b, w in sorted((p for p in places if _stands_alone(text, *p)), key=lambda p: (p[0], -p[1])):
        if a >= last:
            out.append((tab, i, owner, doc, _place(text, a), a, b, w, "again"))
            last = b
    return out


def redact(chunks: DataFrame, vectors: DataFrame, mark: str = "REDACTED", only_changed: bool = True) -> DataFrame:
    """``tab, id, content``: the rows whose text holds a secret, or all, with each replaced by ``mark`` and all else intact.

    Quotes, separators and line ends around a value stay; a value over several
    literals or lines is replaced piece by piece, so the code keeps its shape.
    Repeated rows stay repeated; rows without id or content are left out.
    """
    places = detect(chunks, vectors).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    texts = _texts(chunks, vectors).join(places, "doc", "inner" if only_changed else "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [blank(t, [(s["start"], s["stop"]) for s in spans], mark) if spans else t for t, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["tab", "id", "content"])

    return texts.select("tab", "id", "content", "spans").mapInArrow(run, "tab string, id string, content string")


def blank(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        value = text[a:b]
        pieces = re.split(r"(\\n|[\"'`]?[\s+,\\]*\n[\s+#/*]*[\"'`]?|[\"'`]\s*[+,]\s*[\"'`])", value)
        out += [text[at:a], "".join(mark if k % 2 == 0 and p.strip() else p for k, p in enumerate(pieces))]
        at = b
    return "".join([*out, text[at:]])
