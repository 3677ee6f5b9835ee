"""Definitions in source text of brace languages: names, kinds, nesting and line spans.

Comments and literals are blanked out first, so braces and keywords in them
count nothing. A parser of another kind can be put in place of ``definitions``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

#: Longest name, and the size of a chunk in bytes.
NAME_BYTES, CHUNK_BYTES = 128, 2500
_HIDE = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])\'', re.S)
_MODS = r"(?:(?:public|private|protected|static|final|abstract|async|export|default|declare|override|readonly|synchronized|sealed|internal|inline|extern|const|unsafe|virtual)\s+)*"
_TYPED = r"(?:[\w.:]+(?:<[^<>{}();]*(?:<[^<>{}();]*>[^<>{}();]*)*>)?(?:\[\])*[\s*&]+)"
#: What a definition looks like, by language: (kind, pattern with the name as group 1).
RULES = {
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)\s*\{"), ("impl", r"\bimpl\b(?:\s*<[^{}]*?>)?\s*(?:[^{};]*?\bfor\s+)?([\w:]+)[^{};]*\{")],
    "go": [("method", r"^func\s*\([^()]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^type\s+(\w+)\s+(?!struct|interface)\S")],
    "java": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("record", r"\brecord\s+(\w+)\s*[(<]"), ("method", rf"^[ \t]*{_MODS}(?:<[^<>]*>\s*)?(?!return\b|new\b|else\b|throw\b){_TYPED}(\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws[\w\s,.]+)?\{{")],
    "javascript": [("class", r"\bclass\s+(\w+)"), ("function", r"\bfunction\s*\*?\s*(\w+)"), ("function", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>"), ("method", r"^[ \t]+(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(#?\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*\{")],
    "c": [("struct", r"\bstruct\s+(\w+)\s*\{"), ("union", r"\bunion\s+(\w+)\s*\{"), ("enum", r"\benum\s+(\w+)\s*\{"), ("function", rf"^(?!\s)(?:static\s+|inline\s+|extern\s+|const\s+|unsigned\s+|struct\s+)*{_TYPED}\**(\w+)\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*\{{")],
}
RULES["typescript"] = [*RULES["javascript"][:3], ("interface", r"\binterface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)(?:<[^=]*>)?\s*="), ("enum", r"\benum\s+(\w+)"), ("namespace", r"\b(?:namespace|module)\s+([\w.]+)\s*\{"), ("method", r"^[ \t]+(?:(?:public|private|protected|static|abstract|override|readonly|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(#?\w+)\s*(?:<[^<>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^{};=]+)?\{")]
RULES["cpp"] = [("class", r"\bclass\s+(\w+)[^;{}()]*\{"), ("namespace", r"\bnamespace\s+([\w:]+)\s*\{"), *RULES["c"]]
RULES["csharp"] = [("namespace", r"\bnamespace\s+([\w.]+)"), ("struct", r"\bstruct\s+(\w+)"), *RULES["java"]]
RULES["kotlin"] = [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"\bfun\s+(?:<[^<>]*>\s*)?(?:\w+\.)?(\w+)\s*\("), ("object", r"\bobject\s+(\w+)")]
RULES["swift"] = [("class", r"\bclass\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("protocol", r"\bprotocol\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("function", r"\bfunc\s+(\w+)")]
RULES["scala"] = [("class", r"\bclass\s+(\w+)"), ("object", r"\bobject\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("function", r"\bdef\s+(\w+)")]
RULES["php"] = [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("function", r"\bfunction\s+&?(\w+)")]
RULES["objective-c"] = [("class", r"@(?:interface|implementation)\s+(\w+)"), ("protocol", r"@protocol\s+(\w+)(?!\s*[;,])"), ("method", r"^[-+]\s*\([^()]*\)\s*(\w+)[^;{}]*(?=\{)"), *RULES["c"]]
#: Words that open a block up to ``end`` where a statement begins with them, and definitions among them.
_RUBY_OPENS = re.compile(r"(?:^|;|=)[ \t]*(?:(?:private|protected|public)[ \t]+)?(class|module|def|if|unless|while|until|case|begin|for)\b(?![?!:])|\b(do)\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?:$|;))|(?<![.\w:])(end)\b(?![?!:])", re.M)
_RUBY_NAME = re.compile(r"[ \t]+(?:<<[ \t]*self|(?:self\.)?([\w:]+[?!=]?|[-+*/<=>!\[\]%&|^~]+))")
_RUBY_SHORT = re.compile(r"(?:\([^()\n]*\))?[ \t]*=[ \t]")
_RUBY_HIDE = re.compile(r"^=begin\b.*?^=end\b[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|(?<!\S)#[^\n]*", re.S | re.M)
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in RULES.items()}
_NEEDS_BODY = {"c": {"struct", "union", "enum"}, "cpp": {"struct", "union", "enum", "class"}}


class Definition(NamedTuple):
    kind: str
    name: str
    container: str | None
    start: int
    end: int


def _ruby(text: str) -> list[Definition]:
    """Classes, modules and methods from ``class`` and the like to their ``end``; a method without one ends with its line."""
    bare = _RUBY_HIDE.sub(_blank, text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    open_: list[Definition | None] = []
    out: list[Definition] = []
    loop = -1  # a loop's own ``do`` opens nothing more
    for m in _RUBY_OPENS.finditer(bare):
        line = bisect_right(starts, m.start(3) if m[3] else m.end() - 1)
        if m[3]:
            done = open_.pop() if open_ else None
            if done:
                out.append(done._replace(end=line))
            continue
        if m[2]:
            if line != loop:
                open_.append(None)
            continue
        if m[1] in ("while", "until", "for"):
            loop = line
        name = _RUBY_NAME.match(bare, m.end()) if m[1] in ("class", "module", "def") else None
        if m[1] == "def" and name and _RUBY_SHORT.match(bare, name.end()):
            box = "::".join(d.name for d in open_ if d) or None
            out.append(Definition("method" if box else "function", name[1], box, line, line))
            continue
        if name and name[1] and len(name[1].encode()) <= NAME_BYTES:
            box = "::".join(d.name for d in open_ if d) or None
            kind = {"def": "method" if box else "function"}.get(m[1], m[1])
            open_.append(Definition(kind, name[1], box, line, line))
        else:
            open_.append(None)
    return sorted(out, key=lambda d: (d.start, -d.end))


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def definitions(text: str, language: str) -> list[Definition]:
    """Definitions in document order; ``container`` joins the names of the enclosing ones by ``::``.

    A definition ends with its body, or with its line where it has none. Of several
    that begin at the same name, the first rule counts.
    """
    if language == "ruby":
        return _ruby(text)
    rules = _COMPILED.get(language)
    if not rules:
        return []
    bare = _HIDE.sub(_blank, text)
    ends, stack = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    found: dict[int, tuple[int, int, str, str]] = {}
    for kind, pattern in rules:
        for m in pattern.finditer(bare):
            name = m[1]
            if len(name.encode()) > NAME_BYTES or m.start(1) in found:
                continue
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            stop = re.compile(r"[{;]").search(bare, m.end(1))
            body = ends.get(stop.start()) if stop and stop.group() == "{" else None
            if bare[m.start() : m.start() + 1] == "@":  # up to its @end
                close = bare.find("@end", m.end())
                body = close + 4 if close >= 0 else len(bare)
            if body is None and (kind in _NEEDS_BODY.get(language, ()) or stop is None):
                continue
            found[m.start(1)] = (begin, body or stop.end(), kind, name)
    out: list[Definition] = []
    above: list[tuple[int, str]] = []
    for begin, end, kind, name in sorted(found.values(), key=lambda x: (x[0], -x[1])):
        while above and above[-1][0] <= begin:
            above.pop()
        box = "::".join(n for _, n in above) or None
        out.append(Definition(kind, name, box, bisect_right(starts, begin), bisect_right(starts, end - 1)))
        above.append((end, name))
    return out


def refined(content: str, start: int, most: int = CHUNK_BYTES) -> list[tuple[str, int, int]]:
    """A chunk over ``most`` bytes is cut into pieces of whole lines, without blanks at their ends."""
    if len(content.encode()) <= most:
        return [(content, start, start + content.count("\n"))]
    out, part, size, first = [], [], 0, start
    for i, line in enumerate(content.split("\n")):
        n = len(line.encode()) + 1
        if part and size + n > most:
            out.append(("\n".join(part).rstrip(), first, start + i - 1))
            part, size, first = [], 0, start + i
        part.append(line)
        size += n
    out.append(("\n".join(part).rstrip(), first, start + content.count("\n")))
    return [x for x in out if x[0].strip()]
