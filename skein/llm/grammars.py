"""Syntax checks of source text by bracket contraction over compact grammars.

A text is tokenized into a string with one character per token kind (keyword,
operator, name, number, string). Brackets are then contracted from the inside
out: the content of a closed group is matched against the rules that groups of
its bracket can have (block, arguments, parameters, object, type ...), and the
whole group becomes one character that stands for the *set* of rules that fit.
What is left between brackets is flat, so every rule is a regular expression
over kinds and group sets; nesting is carried by the contraction. As the
alphabet is finite, the same few contents come up again and again, and the set
of a content is looked up instead of matched. A text fits its grammar if no
group is left without a rule and the outermost sequence is a whole unit.

Rules are written as words: ``<x>`` refers to another rule, ``@x`` to a group
that fits rule ``x``, ``( ) | * + ?`` mean what they mean in regular
expressions, ``'`` quotes such a word, anything else is a token.
"""

from __future__ import annotations

import ast
import re
import warnings

import regex

_META = {"(": "(?:", ")": ")", "|": "|", "*": "*", "+": "+", "?": "?", "*+": "*+", "++": "++", "(?>": "(?>", "(?!": "(?!", "(?=": "(?=", "(?<=": "(?<=", "(?<!": "(?<!", ".": "."}
#: Tokens of which a rule's content has one at least, unless it is empty, and rules whose content has no semicolon.
_NEEDED = {"swbody": ("case", "default"), "arms": ("=>",), "for": (";", ":", "of", "in")}
_WITHOUT_SEMICOLON = frozenset("args annargs cast params lparams expr type object objpat specs enums slit pstruct fields variants utrees tfields ebody_c arms_c ptuple arrpat partype catch init".split())
_OPEN = {"(": "(", "[": "[", "{": "{"}
_CLOSE = {")": "(", "]": "[", "}": "{"}
_CALLED = re.compile(r"\(\?&(\w+)\)")
_TIED = re.compile(r"\)([*+?]+)(?=\s|$)")
_BRACKET = re.compile(r"[()\[\]{}]")
_INNERMOST = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_WHOLE = re.compile(r".*", re.S)
#: Passes over a text before deeper nesting is left to a stack.
_PASSES = 24


class _Misfit(Exception):
    """A group that fits no rule."""


class Grammar:
    """One language: a token pattern, the kinds of tokens, and rules for groups and the whole text."""

    def __init__(self, tokens: str, keywords: str, operators: str, rules: dict[str, str], groups: dict[str, list[str]], unit: str, sequences: dict[str, tuple[str, str]], always: bool = False, never: str = ""):
        name = r"(?:[^\W\d]|\$)(?:\w|\$)*" if r"\$)*" in tokens else _NAME
        # Names and the commonest marks first, blanks skipped at once; C needs the blanks before a directive.
        self.token = re.compile(tokens if "PREPROC" in keywords else rf"[ \t\r]*((?![bcr]{{1,2}}[\"'#]){name}|[;(){{}},]|{tokens})", re.S)
        self.spanning = re.compile(r"`|\"\"\"|\\\\\n" + ("|\"" if always else ""))  # marks of tokens that may span lines
        self.always = always  # a group that fits no rule may still be the argument of a macro
        names = ["ID", "NUM", "STR", "ERR", "NL", *dict.fromkeys(keywords.split()), *dict.fromkeys(operators.split())]
        self.char = {w: chr(0x100 + i) for i, w in enumerate(names)}
        self.char |= {b: b for b in "()[]{}"}
        self.kinds = _Kinds(self.char)
        self.rules, self.groups = rules, groups
        base, self.base, self.bit = 0x2000, {}, {}
        for bracket, modes in groups.items():
            self.base[bracket] = base
            for i, m in enumerate(modes):
                self.bit[m] = (bracket, 1 << i)
            base += 1 << len(modes)
        written = {n: self._rule(r) for n, r in rules.items()}

        def rule(text: str, raw: str = "") -> regex.Pattern:
            body = raw or self._rule(text)
            used, todo = set(), [body]
            while todo:  # only rules that are reached are compiled
                fresh = set(_CALLED.findall(todo.pop())) - used
                used |= fresh
                todo += [written[n] for n in fresh]
            defined = "".join(f"(?P<{n}>{written[n]})" for n in written if n in used)
            return regex.compile(f"(?(DEFINE){defined})(?:{body})" if defined else f"(?:{body})", regex.V1)

        # One pattern for all plain rules: the first character says which of them the rest must fit.
        plain = [m for modes in groups.values() for m in modes if m not in sequences] + [unit] * (unit not in sequences)
        chosen = rule("", "|".join(f"{chr(1 + i)}(?&{m})" for i, m in enumerate(plain))).fullmatch
        mark = {m: chr(1 + i) for i, m in enumerate(plain)}

        def whole(mode: str):
            if mode in sequences:
                return _Sequence(rule(sequences[mode][0]), rule(sequences[mode][1]) if sequences[mode][1] else None).fullmatch
            return lambda content, c=mark[mode]: chosen(c + content)

        def tried(mode: str) -> tuple:
            need = {self.char[w] for w in _NEEDED.get(mode, ()) if w in self.char}
            banned = self.char[";"] if mode in _WITHOUT_SEMICOLON and unit == "unit" else "\0"
            return whole(mode), need, banned

        self.never = re.compile(self._kinds(never)).search if never else None
        self.match = {b: [tried(m) for m in modes] for b, modes in groups.items()}
        self.unit = whole(unit)
        self.sets: dict[str, dict[str, str]] = {b: {} for b in groups}
        self.any = {b: chr(self.base[b]) for b in groups}

    def _kinds(self, text: str) -> str:
        """A plain pattern over kinds, in which ``{a b}`` is any of the named kinds."""
        return re.sub(r"\{([^}]*)\}", lambda m: "[" + "".join(re.escape(self.char[w]) for w in m[1].split()) + "]", text)

    def _rule(self, text: str) -> str:
        return "".join(map(self._word, _TIED.sub(r") \1", text).split()))

    def _word(self, w: str) -> str:
        if w in _META:
            return _META[w]
        if w[0] == "<" and w[-1] == ">" and len(w) > 2:
            return f"(?&{w[1:-1]})"
        if w[0] == "@" and len(w) > 1:
            if w == "@any":
                return "[" + "".join(f"{chr(self.base[b])}-{chr(self.base[b] + (1 << len(m)) - 1)}" for b, m in self.groups.items()) + "]"
            bracket, bit = self.bit[w[1:]]
            return "[" + "".join(chr(self.base[bracket] + s) for s in range(1 << len(self.groups[bracket])) if s & bit) + "]"
        if w[0] == "'" and len(w) > 1:
            w = w[1:]
        return re.escape(self.char[w])

    def _set(self, bracket: str, whole: str) -> str:
        """The character for the set of rules that the content of the group ``whole`` fits; empty if there is none."""
        known = self.sets[bracket]
        if len(known) > 200_000:
            known.clear()
        content = self.inside(bracket, whole[1:-1])
        there = set(content)
        mask = 0
        for i, (fits, need, banned) in enumerate(self.match[bracket]):
            if banned not in there and (not need or not content or need & there) and fits(content):
                mask |= 1 << i
        c = chr(self.base[bracket] + mask) if mask or self.always else ""
        if len(content) < 2000:
            known[whole] = c
        return c

    def flat(self, text: str) -> str:
        """The kinds of the tokens of ``text``; a language with significant line ends overrides this."""
        return "".join(map(self.kinds.__getitem__, self.token.findall(text)))

    def fits(self, text: str) -> bool:
        kinds = self.flat(text)
        if self.char["ERR"] in kinds or self.never and self.never(kinds):
            return False
        outer = self._contract(kinds, closed=True)
        return outer is not None and bool(self.unit(outer))

    def may_fit(self, text: str, steps: tuple[int, ...] = (100, 400, 2000)) -> bool:
        """False if the tokens of an opening already show that ``text`` does not fit.

        They are the tokens of the whole text, and nothing is held against the last,
        open line or item, so this never rejects a text that ``fits`` accepts.
        """
        for some in steps:
            if len(text) <= some:
                return True
            kinds = self.opening(text, some)
            if self.char["ERR"] in kinds:
                return False
            outer = self._contract(kinds, closed=False)
            if outer is None or not self.unit.__self__.may_go_on(outer):
                return False
        return True

    def opening(self, text: str, some: int) -> str:
        """The kinds of whole lines within the first ``some`` characters, as ``flat`` would give them in the whole text."""
        cut = text.rfind("\n", 0, some) + 1
        comment = text.rfind("/*", 0, cut)
        if comment >= 0 and text.find("*/", comment + 2, cut) < 0:  # may go on behind the cut
            cut = text.rfind("\n", 0, comment) + 1
        if not cut:
            return ""
        kinds = self.flat(text[:cut])
        if self.char["ERR"] in kinds and self.spanning.search(text, 0, cut):
            end = 0  # a string of several lines may be cut off: go by the tokens themselves
            for m in self.token.finditer(text):
                if m.end() > cut:
                    cut = text.rfind("\n", 0, max(end, m.start()) if end else m.start()) + 1
                    break
                end = m.end()
            kinds = self.flat(text[:cut]) if cut else ""
        return kinds

    def _contract(self, kinds: str, closed: bool) -> str | None:
        """What stands between outermost brackets; None for a group or bracket that does not fit, or that is open but must be ``closed``."""

        def group(m: re.Match) -> str:
            b = m[0][0]
            c = self.sets[b].get(m[0])
            if c is None:
                c = self._set(b, m[0])
            if not c:
                raise _Misfit
            return c

        try:
            for _ in range(_PASSES):  # all innermost groups at once
                kinds, n = _INNERMOST.subn(group, kinds)
                if not n:
                    break
            else:
                kinds = self._contract_deep(kinds, group)
        except _Misfit:
            return None
        rest = _BRACKET.search(kinds)
        if rest is None:
            return kinds
        if closed or any(b in kinds for b in _CLOSE):
            return None
        return kinds[: rest.start()]

    def _contract_deep(self, kinds: str, group) -> str:
        """The same from left to right with a stack, whose time does not grow with the depth."""
        stack: list[tuple[str, list[str]]] = []
        parts: list[str] = []
        at = 0
        for m in _BRACKET.finditer(kinds):
            b, i = m.group(), m.start()
            if i > at:
                parts.append(kinds[at:i])
            at = i + 1
            if b in _OPEN:
                stack.append((b, parts))
                parts = []
            elif not stack or stack[-1][0] != _CLOSE[b]:
                raise _Misfit
            else:
                done = group(_WHOLE.match(_CLOSE[b] + "".join(parts) + b))
                parts = stack.pop()[1]
                parts.append(done)
        parts.append(kinds[at:])
        while stack:
            b, above = stack.pop()
            parts = [*above, b, *parts]
        return "".join(parts)

    def inside(self, bracket: str, content: str) -> str:
        return content


class _Sequence:
    """Items one after the other, then a tail. The few distinct items are matched once.

    An item's match depends on its own kinds and the next one only, so an item
    seen before, with the same kind after it, is skipped by its length.
    """

    def __init__(self, item: regex.Pattern, tail: regex.Pattern | None):
        self.item, self.tail = item.match, tail.fullmatch if tail else None
        self.seen: set[str] = set()
        self.begun: dict[str, bool] = {}
        self.rests: dict[str, bool] = {}
        self.lengths: dict[str, list[int]] = {}

    def may_go_on(self, content: str) -> bool:
        """Could ``content`` be the beginning of a sequence?"""
        known = self.begun.get(content)
        if known is None:
            if len(self.begun) > 50_000:
                self.begun.clear()
            at, known = 0, True
            while at < len(content):
                m = self.item(content, at, partial=True)
                if m is None:
                    known = False
                if m is None or m.partial or m.end() == at:
                    break
                at = m.end()
            self.begun[content] = known
        return known

    def fullmatch(self, content: str) -> bool:
        at, n, seen = 0, len(content), self.seen
        ended = content + "\0"
        while at < n:
            head = content[at : at + 3]
            for size in self.lengths.get(head, ()):
                if at + size <= n and ended[at : at + size + 1] in seen:
                    at += size
                    break
            else:
                rest = content[at:]
                if rest in self.rests:
                    return self.rests[rest]
                m = self.item(content, at)
                if not m or m.end() == at:
                    fits = self.tail is not None and self.tail(rest) is not None
                    if len(rest) < 400:
                        if len(self.rests) > 200_000:
                            self.rests.clear()
                        self.rests[rest] = fits
                    return fits
                size = m.end() - at
                if size < 400:
                    if len(seen) > 200_000:
                        seen.clear()
                        self.lengths.clear()
                    seen.add(ended[at : at + size + 1])
                    known = self.lengths.setdefault(head, [])
                    if size not in known:
                        known.append(size)
                at = m.end()
        return self.tail is None or self.tail("") is not None


class _Kinds(dict):
    """Token text to kind character; looked up once per distinct token."""

    def __init__(self, char: dict[str, str]):
        super().__init__(char)
        for k in ("ID", "NUM", "STR", "ERR", "NL"):
            self.pop(k, None)
        self.char = char

    def __missing__(self, t: str) -> str:
        c = self.char
        first = t[0]
        if t.startswith(("//", "/*")):
            k = c["NL"] if "\n" in t else ""
        elif (first == "#" and len(t) > 1 or first in " \t") and "PREPROC" in c:
            k = ""
        elif first.isalpha() or first in "_$" and len(t) > 0 or t[:2] == "r#":
            k = c["ID"]
            if t[-1] in "\"'#" and len(t) > 1 and not t.startswith("r#"):
                k = c["STR"]
            elif t[:2] == "r#" and t[-1] in "\"#":
                k = c["STR"]
        elif first.isdigit() or first == "." and len(t) > 1 and t[1].isdigit():
            k = c["NUM"]
        elif first == "'" and "LIFETIME" in c and (len(t) < 2 or t[-1] != "'"):
            k = c["LIFETIME"]
        elif first in "\"'`" and len(t) > 1 or first == "/" and len(t) > 2:
            k = c["STR"]
        elif first == "\n":
            k = c["NL"]
        elif first == "﻿":
            k = ""
        else:
            k = c["ERR"]
        if len(self) > 300_000:
            self.clear()
            self.update({w: x for w, x in c.items() if w not in ("ID", "NUM", "STR", "ERR", "NL")})
        self[t] = k
        return k


def _ops(operators: str) -> str:
    return "|".join(re.escape(o) for o in sorted(operators.split(), key=len, reverse=True))


_NUM = r"(?:0[xX][0-9A-Fa-f_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![.0-9eE])|\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+-]?[\d_]+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[A-Za-z0-9_]*"
_STRING = r'"(?:[^"\\\n]|\\.)*"'
_CHAR = r"'(?:[^'\\\n]|\\.)*'"
_NAME = r"[^\W\d]\w*"
_BLOCK_COMMENT = r"/\*.*?\*/"

# ---------------------------------------------------------------- Java

_JAVA_OPS = "; , . ... @ = + - * / % & | ^ ! ~ ? : :: -> ++ -- += -= *= /= %= &= |= ^= << <<= >>= >>>= == != <= >= < > && ||"
_JAVA_PRIM = "int long double float boolean byte char short void"
JAVA_RULES = {
    "id": "ID | record | yield | sealed | when",
    "prim": " | ".join(_JAVA_PRIM.split()),
    "name": "<id> ( '. <id> )*",
    "ann": "@ <name> ( @args | @annargs ) ?",
    "arg2": "<ann> * ( '? ( ( extends | super ) <type> ) ? | <type> ( '& <type> )* )",
    "targs": "< ( ( <arg2> ) ( , <arg2> )* ) ? >",
    "type": "( <ann> * <id> <targs> ? ( '. <id> <targs> ? )* | <prim> ) @index *",
    "tparams": "< <id> ( extends <type> ( '& <type> )* ) ? ( , <id> ( extends <type> ( '& <type> )* ) ? )* >",
    "mods": "( public | private | protected | static | final | abstract | synchronized | native | default | volatile | transient | strictfp | sealed (?= class | interface | abstract | public | private | protected | static | strictfp | @ | ID ) | ID - sealed | <ann> )*",
    "assign": "= | += | -= | *= | /= | %= | &= | |= | ^= | <<= | >>= | >>>=",
    "exprstmt": "<operand> ( (?<= @args | @cbody | '++ | -- ) (?! <bin> | '? | instanceof ) | ( <assign> ) <expr> ) | ( '++ | -- ) <operand>",
    "post": "'. ( <targs> ? <id> | class | this | super | new <id> <targs> ? @args ) | @args | @index | '++ | -- | :: ( <id> | new )",
    "prim_e": "NUM | STR | true | false | null | this | super | new <id> <targs> ? ( '. <id> <targs> ? )* ( @args @cbody ? | @index + @init ? ) | new <prim> @index + @init ? | <type> :: ( <id> | new ) | <prim> @index * '. class | @expr | switch @expr @swbody | <id>",
    "un": "( '+ | - | ! | ~ | '++ | -- | @cast )* ( <id> -> | @lparams -> )*",
    "operand": "(?> <un> ( @block (?! '. ) | <prim_e> ( <post> )* ) )",
    "bin": "= | '+ | - | '* | / | % | '& | '| | ^ | << | > > > | > > | < | > | <= | >= | == | != | && | '|| | += | -= | *= | /= | %= | &= | |= | ^= | <<= | >>= | >>>=",
    "chain": "<operand> ( ( <bin> ) <operand> | instanceof final ? <type> ( <id> | @params ) ? )*+",
    "tern": "<chain> ( '? <chain> ( '? <chain> : <chain> )* : <chain> )*",
    "expr": "<tern>",
    "args": "( <expr> ( , <expr> )* ) ?",
    "annargs": "( <id> = ( <expr> | @init | <ann> ) ( , <id> = ( <expr> | @init | <ann> ) )* ) ? | <ann> | @init",
    "cast": "<type> ( '& <type> )*",
    "param": "<mods> <type> ( '... ) ? ( <id> @index * | this )",
    "params": "( <param> ( , <param> )* ) ?",
    "lparams": "( <id> ( , <id> )* ) ? | <params>",
    "index": "( <expr> ) ?",
    "init": "( ( <expr> | @init ) ( , ( <expr> | @init ) )* , ? ) ? | <ann> ( , <ann> )*",
    "declr": "<id> @index * ( = ( <expr> | @init ) ) ?",
    "decl": "<mods> <type> <declr> ( , <declr> )*",
    "for": "( <decl> | <expr> ( , <expr> )* ) ? ; <expr> ? ; ( <expr> ( , <expr> )* ) ? | <mods> <type> <id> : <expr>",
    "res": "( <mods> <type> <id> = <expr> | <expr> ) ( ; ( <mods> <type> <id> = <expr> | <expr> ) )* ; ?",
    "catch": "<mods> <type> ( '| <type> )* <id>",
    "handled": "( catch @catch @block )+ ( finally @block ) ? | finally @block",
    "simple": "@block | ; | return <expr> ? ; | yield <expr> ; | throw <expr> ; | ( break | continue ) <id> ? ; | assert <expr> ( : <expr> ) ? ; | <decl> ; | <exprstmt> ; | try ( @block ( <handled> ) | @res @block ( <handled> ) ? ) | switch @expr @swbody | do <stmt> while @expr ; | synchronized @expr @block | <class>",
    "stmt": "(?> if @expr <stmt> ( else <stmt> ) ? | ( while @expr | for @for | <id> : ) <stmt> | <simple> )",
    "block": "( <stmt> )*+",
    "pattern": "final ? <type> ( @params <id> ? | <id> )",
    "noarrow": "(?> ( '+ | - | ! | ~ | '++ | -- | @cast )* ( <prim_e> ) ( <post> )* )",
    "guard": "<noarrow> ( ( <bin> ) <noarrow> | instanceof final ? <type> ( <id> | @params ) ? )*",
    "caselabel": "case ( <pattern> | <guard> ) ( , ( <pattern> | <guard> | default ) )* ( when <guard> ) ? | default",
    "swbody": "(?> <caselabel> ( : | -> <expr> ; | -> ) | <stmt> )*+",
    "list": "<type> ( , <type> )*",
    "class": "<mods> ( ( class | interface ) <id> <tparams> ? ( extends <list> ) ? ( implements <list> ) ? ( <id> <list> ) ? @cbody | enum <id> ( implements <list> ) ? @ebody | record <id> <tparams> ? @params ( implements <list> ) ? @cbody | @ interface <id> @cbody )",
    "member": "(?> ; | static ? @block | <class> | <mods> <tparams> ? <type> ? <id> @params @index * ( throws <list> ) ? ( @block | ; | default ( <expr> | @init ) ; ) | <mods> <id> @block | <decl> ; )",
    "cbody": "( <member> )*+",
    "econst": "<ann> * <id> @args ? @cbody ?",
    "ebody": "( <econst> ( , <econst> )* ) ? , ? ( ; ( <member> )*+ ) ?",
    "unit": "( <ann> * package <name> ; ) ? ( import static ? <name> ( '. '* ) ? ; | ; )* ( <class> | ; )*+",
}

# ---------------------------------------------------------------- C

_C_OPS = "; , . ... = + - * / % & | ^ ! ~ ? : -> ++ -- += -= *= /= %= &= |= ^= << <<= >> >>= == != <= >= < > && ||"
_C_PRIM = "int char short long float double void unsigned signed _Bool"
_C_QUAL = "const volatile restrict static extern inline register auto __inline _Noreturn _Thread_local __restrict _Atomic"
C_RULES = {
    "id": "ID",
    "qual": " | ".join(_C_QUAL.split()) + " | __attribute__ @any",
    "asm": "( asm | __asm__ | __asm ) ( volatile | __volatile__ | inline | goto )* @asmbody",
    "asmop": "( @index ) ? STR ( @expr ) ?",
    "asmbody": "<id> ? ( STR <id> ? )+ ( : ( <asmop> ( , <asmop> )* | <id> ( , <id> )* ) ? )*",
    "prims": "( ( " + " | ".join(_C_PRIM.split()) + " ) ( <qual> )* )+",
    "base": "<prims> | ( struct | union ) <id> ( @sbody ) ? | ( struct | union ) @sbody | enum <id> ? @ebody | enum <id> | typeof @args | <id>",
    "spec": "( <qual> )* ( <base> ) ( <qual> )*",
    "ptr": "( '* ( <qual> )* )*",
    "suffix": "( @index | @params )*",
    "declr": "<ptr> ( <id> | @declr ) <suffix> ( : <expr> ) ? ( __attribute__ @any ) ?",
    "adeclr": "<ptr> ( <id> | @declr ) ? <suffix>",
    "typename": "<spec> <ptr> ( @declr ) ? <suffix>",
    "prim_e": "NUM | <id> ? ( STR <id> ? )+ | <id> | @expr | sizeof @type | @type @init",
    "post": "'. <id> | -> <id> | @args | @index | '++ | --",
    "un": "( '+ | - | ! | ~ | '& | '* | '++ | -- | sizeof | @type )*",
    "operand": "(?> <un> ( <prim_e> ) ( <post> )* )",
    "bin": "= | '+ | - | '* | / | % | '& | '| | ^ | << | >> | < | > | <= | >= | == | != | && | '|| | += | -= | *= | /= | %= | &= | |= | ^= | <<= | >>=",
    "chain": "<operand> ( ( <bin> ) <operand> )*+",
    "tern": "<chain> ( '? <chain> ? ( '? <chain> : <chain> )* : <chain> )*",
    "expr1": "<tern>",
    "expr": "<tern> ( , <tern> )*",
    "args": "( ( <expr1> | <typename> ) ( , ( <expr1> | <typename> ) )* ) ?",
    "type": "<typename>",
    "param": "<spec> <adeclr>",
    "params": "( <param> ( , <param> )* ( , '... ) ? ) ?",
    "declr_g": "<ptr> <id> <suffix> | <ptr> @declr <suffix> | '* ( <qual> )*",
    "index": "( ( static | const | <qual> ) * <expr> ) ?",
    "initem": "( ( '. <id> | @index )+ = ) ? ( <expr1> | @init )",
    "init": "( <initem> ( , <initem> )* , ? ) ?",
    "decl": "typedef ? <spec> ( <declr> ( = ( <expr1> | @init ) ) ? ( , <declr> ( = ( <expr1> | @init ) ) ? )* ) ?",
    "field": "(?> <spec> ( ( <declr> | : <expr1> ) ( , <declr> )* ) ? ; | ; )",
    "sbody": "( <field> )*+",
    "ebody": "<id> ( = <expr1> ) ? ( , <id> ( = <expr1> ) ? )* , ?",
    "for": "( <decl> | <expr> ) ? ; <expr> ? ; <expr> ?",
    "label": "<id> : | case <expr1> ( '... <expr1> ) ? : | default :",
    "simple": "@block | ; | return ( <expr> | @init ) ? ; | ( break | continue ) ; | goto ( '* <operand> | <id> ) ; | do <stmt> while @expr ; | <asm> ; | <decl> ; | <expr> ;",
    "stmt": "(?> if @expr <stmt> ( else <stmt> ) ? | ( while @expr | for @for | switch @expr | <label> ) <stmt> | <simple> )",
    "block": "( <stmt> )*+ ( <label> )*",
    "top": "(?> ; | typedef ? <spec> <ptr> ( <id> | @declr ) @params ( <spec> <declr> ( , <declr> )* ; )* @block | <decl> ; | <asm> ; | extern STR @ctop | <id> @args ; ? )",
    "ctop": "( <top> )*+",
    "unit": "( <top> )*+",
}

# ---------------------------------------------------------------- Go

_GO_OPS = "; , . ... = := + - * / % & | ^ &^ ! : <- ++ -- += -= *= /= %= &= |= ^= &^= << <<= >> >>= == != <= >= < > && || ~"
GO_RULES = {
    "id": "ID",
    "qid": "<id> ( '. <id> ) ?",
    "tpre": "( '* | @index | @arr | map @index | map @targs | chan | <- chan | chan <- )*",
    "func_t": "func @params ( <result> ) ?",
    "type": "<tpre> ( <qid> @targs ? | struct @sbody | interface @ibody | @partype | func @params ( <result> ) ? )",
    "result": "<type> | @params",
    "lit_t": "( @index | @arr | map @index | map @targs ) <type> | struct @sbody | <qid> @targs ?",
    "prim_e": "func @params ( <result> ) ? @block | NUM | STR | ( @index | @arr | map @index ) <type> ( @lit | (?= @args ) ) | struct @sbody @lit | <qid> @targs ? @lit | <id> | @expr | @partype (?= @args ) | ( interface @ibody | chan <type> | map @index <type> ) (?= @args )",
    "prim_n": "func @params ( <result> ) ? @block | NUM | STR | ( @index | @arr | map @index ) <type> ( @lit | (?= @args ) ) | <id> | @expr | ( interface @ibody | chan <type> | map @index <type> ) (?= @args )",
    "post": "'. <id> | '. @tassert | @args | @index | @slice | @targs",
    "un": "( '+ | - | ! | ^ | '* | '& | <- )*",
    "operand": "(?> <un> ( <prim_e> ) ( <post> )* )",
    "operand_n": "(?> <un> ( <prim_n> ) ( <post> )* )",
    "bin": "'+ | - | '* | / | % | '& | '| | ^ | &^ | << | >> | < | > | <= | >= | == | != | && | '||",
    "expr": "<operand> ( ( <bin> ) <operand> )*+",
    "expr_n": "<operand_n> ( ( <bin> ) <operand_n> )*+",
    "exprs": "<expr> ( , <expr> )*",
    "exprs_n": "<expr_n> ( , <expr_n> )*",
    "assign": "= | := | += | -= | *= | /= | %= | &= | |= | ^= | &^= | <<= | >>=",
    "simple": "<exprs> ( ( <assign> ) <exprs> | '++ | -- | <- <expr> ) ?",
    "simple_n": "<exprs_n> ( ( <assign> ) <exprs_n> | '++ | -- | <- <expr_n> ) ?",
    "statement": "<id> ( , <id> )* := <exprs> | <exprs> ( ( <assign> ) (?<! := ) <exprs> | '++ | -- | <- <expr> ) | <operand> (?<= @args ) | <- <operand>",
    "args": "( ( <expr> | <type> ) ( , ( <expr> | <type> ) )* ( '... ) ? , ? ) ?",
    "param": "<id> ( '... ) ? <type> | ( '... ) ? <type>",
    "params": "( <param> ( , <param> )* , ? ) ?",
    "partype": "<type>",
    "tassert": "<type> | type",
    "index": "( <expr> | <type> ) ?",
    "arr": "'...",
    "slice": "<expr> ? : <expr> ? ( : <expr> ) ?",
    "targs": "( <type> ( , <type> )* | <id> ( , <id> )* <con> ( , <id> ( , <id> )* <con> )* ) , ?",
    "con": "~ ? <type> ( '| ~ ? <type> )*",
    "litval": "<expr> | @lit",
    "litem": "( ( <litval> ) : ) ? ( <litval> )",
    "lit": "( <litem> ( , <litem> )* , ? ) ; ? | ",
    "field": "( <id> ( , <id> )* <type> | '* ? <qid> @targs ? ) STR ?",
    "sbody": "( <field> ; )* <field> ?",
    "imeth": "<id> @params ( <result> ) ? | <con>",
    "ibody": "( ( <imeth> ) ; )* ( <imeth> ) ?",
    "vspec": "<id> ( , <id> )* ( <type> ? = <exprs> | <type> ) ?",
    "vgroup": "( <vspec> ; )* <vspec> ?",
    "tspec": "<id> @targs ? = ? <type>",
    "tgroup": "( <tspec> ; )* <tspec> ?",
    "gen": "( var | const ) ( <vspec> | @vgroup ) | type ( <tspec> | @tgroup )",
    "ifhead": "if ( <simple_n> ? ; ) ? <expr_n> @block",
    "forhead": "for ( <simple_n> ? ; <expr_n> ? ; <simple_n> ? | ( <exprs_n> ( := | = ) ) ? range <expr_n> | <expr_n> ) ? @block",
    "stmt": "(?> ( <id> : ) ? ( <ifhead> ( else <ifhead> )* ( else @block ) ? | <forhead> | switch ( <simple_n> ? ; ) ? <simple_n> ? @swbody | select @swbody | return <exprs> ? | ( go | defer ) <expr> | ( break | continue ) <id> ? | goto <id> | fallthrough | @block | <gen> | <statement> ) ? (?= ; | <end> | case | default ) )",
    "end": "(?! . )",
    "block": "( <stmt> ; )*+ <stmt> ?",
    "swbody": "( (?> ( case ( <exprs> | <type> ( , <type> )* | <simple> ) | default ) : ; ? | <stmt> ; ) )*+ ( case ( <exprs> | <type> ( , <type> )* | <simple> ) : | default : ) ? <stmt> ?",
    "impspec": "( <id> | '. ) ? STR",
    "imports": "( <impspec> ; )* <impspec> ?",
    "fn": "func @params ? <id> @targs ? @params ( <result> ) ? @block ?",
    "unit": "; * package <id> ; ( import ( <impspec> | @imports ) ; )* ( (?> ( <fn> | <gen> ) (?= ; | <end> ) ) ; | ; )*+ ( <fn> | <gen> ) ?",
}

# ---------------------------------------------------------------- Rust

_RUST_OPS = "; , . .. ..= ... @ # $ = + - * / % & | ^ ! ? : :: -> => += -= *= /= %= &= |= ^= << <<= >>= == != <= >= < > && || ~"
RUST_RULES = {
    "id": "ID | union | auto | default",
    "seg": "<id> | self | super | crate | Self",
    "attr": "'# ! ? @any",
    "lt": "LIFETIME",
    "targs": "< ( ( <lt> | ( <id> ( = | : ) ) ? <type> | NUM | - NUM | STR | @block ) ( , ( <lt> | ( <id> ( = | : ) ) ? <type> | NUM | @block ) )* , ? ) ? >",
    "qself": "< <type> ( as <type> ) ? >",
    "path": "( :: | <qself> :: ) ? <seg> ( :: ( <seg> | <targs> ) )*",
    "tpath": "( :: | <qself> :: ) ? <seg> ( :: ? <targs> ) ? ( :: <seg> ( :: ? <targs> ) ? )* ( @tytuple ( -> <type> ) ? ) ?",
    "bound": "<lt> | '? ? ( for < ( <lt> , ? )* > ) ? <tpath> | @tytuple",
    "bounds": "( <bound> ) ( '+ <bound> )* '+ ?",
    "type": "( '* ( const | mut ) | ( '& | && ) <lt> ? mut ? )* ( ( dyn | impl ) <bounds> | <tpath> ( ! @any ) ? | @tytuple | @array | ! | _ | ( for < ( <lt> , ? )* > ) ? unsafe ? ( extern STR ? ) ? fn @tytuple ( -> <type> ) ? )",
    "gparam": "<attr> * ( <lt> ( : <lt> ( '+ <lt> )* ) ? | const <id> : <type> ( = ( NUM | @block | <id> ) ) ? | <id> ( : <bounds> ? ) ? ( = <type> ) ? )",
    "generics": "< ( <gparam> ( , <gparam> )* , ? ) ? >",
    "wpred": "( <lt> : <lt> ( '+ <lt> )* | ( for < ( <lt> , ? )* > ) ? <type> : <bounds> ? )",
    "where": "where ( <wpred> ( , <wpred> )* , ? ) ?",
    "plit": "- ? NUM | STR | true | false | <path>",
    "pat0": "( '& | && | ref | mut | box )* ( <id> @ ) ? ( _ | ( <plit> ) ( ( .. | ..= | '... ) ( <plit> ) ? | @pargs | @pstruct | ! @any ) ? | .. ( = ? <plit> ) ? | ..= <plit> | @ptuple | @pslice )",
    "pat": "'| ? <pat0> ( '| <pat0> )*",
    "un": "( - | ! | '* | ( '& | && ) ( mut ) ? | <lt> : | return | break <lt> ? | yield | move | async | static | box | '| ( <pat0> ( : <type> ) ? ( , <pat0> ( : <type> ) ? )* , ? ) ? '| ( -> <type> ) ? | '|| ( -> <type> ) ? | .. | ..= )*",
    "mac": "<path> ! @any",
    "prim_n": "NUM | STR | true | false | <mac> | <path> | @args | @array | ( unsafe | async move ? | const | loop ) @block",
    "post": "'. ( <id> | await ) ( :: <targs> ) ? | '. NUM | '? | @args | @index",
    "cast": "( as <type> )*",
    "operand_n": "(?> <un> ( <prim_n> ) ( <post> )* <cast> | ( return | break <lt> ? | continue <lt> ? | .. ) )",
    "bin": "= | '+ | - | '* | / | % | '& | '| | ^ | << | > > | < | > | <= | >= | == | != | && | '|| | += | -= | *= | /= | %= | &= | |= | ^= | <<= | >>= | .. | ..=",
    "cond": "( let <pat> = ) ? <operand_n> ( ( && let <pat> = | <bin> ) <operand_n> )*+ ( .. (?= @block ) ) ?",
    "blocky": "( <lt> : ) ? ( if <cond> @block ( else if <cond> @block )* ( else @block ) ? | match <cond> @arms | while <cond> @block | loop @block | for <pat> in <cond> @block | unsafe @block | async move ? @block | const @block | @block )",
    "prim_e": "<blocky> | <mac> | <path> @slit | <prim_n>",
    "operand": "(?> <un> ( <prim_e> ) ( <post> )* <cast> | ( return | break <lt> ? | continue <lt> ? | .. ) )",
    "expr": "<attr> * ( let <pat> = ) ? <operand> ( ( <bin> ) <operand> )*+ ( .. ) ?",
    "args": "( <expr> ( , <expr> )* , ? ) ?",
    "array": "( <expr> ( , <expr> )* , ? | <expr> ; <expr> | <type> ( ; <expr> ) ? ) ?",
    "index": "<expr>",
    "tytuple": "( ( ( <id> : ) ? <type> | '... ) ( , ( ( <id> : ) ? <type> | '... ) )* , ? ) ?",
    "pargs": "( <pat> ( , <pat> )* , ? ) ?",
    "ptuple": "( <pat> ( , <pat> )* , ? ) ?",
    "pslice": "( <pat> ( , <pat> )* , ? ) ?",
    "pfield": "<attr> * ( ( <id> | NUM ) : <pat> | ( ref | mut )* <id> | .. )",
    "pstruct": "( <pfield> ( , <pfield> )* , ? ) ?",
    "sfield": "<attr> * ( ( <id> | NUM ) : <expr> | <id> | .. <expr> ? )",
    "slit": "( <sfield> ( , <sfield> )* , ? ) ?",
    "arm": "<attr> * <pat> ( if <cond> ) ? => ( <blocky> , ? | <expr> , )",
    "arms": "(?> <arm> )*+ ( <attr> * <pat> ( if <cond> ) ? => <expr> ) ?",
    "vis": "( pub ( @any ) ? | crate ) ?",
    "field": "<attr> * <vis> <id> : <type>",
    "fields": "( <field> ( , <field> )* , ? ) ?",
    "tfields": "( <attr> * <vis> <type> ( , <attr> * <vis> <type> )* , ? ) ?",
    "variant": "<attr> * <vis> <id> ( @tfields | @fields ) ? ( = <expr> ) ?",
    "variants": "( <variant> ( , <variant> )* , ? ) ?",
    "param": "<attr> * ( ( '& <lt> ? ) ? mut ? self ( : <type> ) ? | <pat0> : <type> | '... )",
    "params": "( <param> ( , <param> )* , ? ) ?",
    "fn": "( default ) ? ( const ) ? ( async ) ? ( unsafe ) ? ( extern STR ? ) ? fn <id> <generics> ? @params ( -> <type> ) ? <where> ? ( @block | ; )",
    "utree": "( :: ? ( <seg> :: )* ( <seg> ( as ( <id> | _ ) ) ? | '* | @utrees ) )",
    "utrees": "( <utree> ( , <utree> )* , ? ) ?",
    "item": "<attr> * <vis> ( <fn> | struct <id> <generics> ? ( <where> ? ( @fields | ; ) | @tfields <where> ? ; ) | ( enum | union ) <id> <generics> ? <where> ? ( @variants | @fields ) | unsafe ? impl <generics> ? ( ! ? <type> for ) ? <type> <where> ? @ibody | unsafe ? auto ? trait <id> <generics> ? ( : <bounds> ? ) ? <where> ? @ibody | mod <id> ( ; | @mod ) | use <utree> ; | ( const | static mut ? ) ( <id> ) : <type> ( = <expr> ) ? ; | type <id> <generics> ? ( : <bounds> ) ? <where> ? ( = <type> ) ? ; | extern crate <seg> ( as <id> ) ? ; | unsafe ? extern STR ? @ibody | macro_rules ! <id> @any ; ? )",
    "ibody": "(?> <item> | <attr> | <mac> ; ? )*+",
    "mod": "(?> <item> | <attr> | <mac> ; ? )*+",
    "stmt": "(?> ; | <attr> * let <pat> ( : <type> ) ? ( = <expr> ( else @block ) ? ) ? ; | <attr> * <blocky> (?! '. | '? | <bin> | as | @args | @array ) | <item> | <expr> ; | <attr> * <blocky> (?! '. | '? ) | <attr> * <path> ! @any (?! '. | '? | <bin> ) )",
    "block": "( <stmt> )*+ <expr> ?",
    "unit": "(?> <item> | <attr> | <mac> ; ? )*+",
}

# ---------------------------------------------------------------- JavaScript and TypeScript

_JS_OPS = "; , . ... = + - * / % ** & | ^ ! ~ ? ?. ?? : => ++ -- += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= << == != === !== <= >= < > && || @ #"
_JS_KW = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while null true false enum"
_JS_CTX = "async await of get set static let yield from as"
_TS_CTX = "type interface namespace module declare abstract readonly public private protected implements keyof infer is satisfies override asserts unique out accessor"
JS_RULES = {
    "id": "ID | " + " | ".join(_JS_CTX.split()) + " | " + " | ".join(_TS_CTX.split()),
    "any_name": "<id> | " + " | ".join(_JS_KW.split()),
    "n": "NL *",
    "t": "(?> [;NL]+ | <end> )",
    "end": "(?! . )",
    "ann": "",
    "ret": "",
    "opt": "",
    "tparams": "",
    "gcall": "(?! )",
    "mod": "(?! )",
    "asx": "(?! )",
    "bang": "(?! )",
    "heritage": "( extends <operand> ) ?",
    "pname": "<any_name> | STR | NUM | @array | '# <any_name>",
    "fn": "async ? function '* ? <id> ? <tparams> @params <ret> @block",
    "fnd": "async ? function '* ? <id> <tparams> @params <ret> @block",
    "clsd": "( @ <operand> <n> )* class (?! extends | implements ) <id> <tparams> <heritage> @cbody",
    "cls": "( @ <operand> <n> )* class ( (?! extends | implements ) <id> ) ? <tparams> <heritage> @cbody",
    "arrow": "async ? ( <id> | <tparams> @params <ret> ) => <n>",
    "post": "'. ( <any_name> | '# <any_name> ) | ?. ( <any_name> | @args | @array | '# <any_name> ) | <gcall> ? @args | @array | STR | <bang>",
    "prim_e": "<fn> | <cls> | NUM | STR | this | super | null | true | false | @expr | @array | @object | import ( @args | '. <id> ) | new '. <id> | '# <any_name> | <id>",
    "un": "( '+ | - | ! | ~ | '++ | -- | typeof | void | delete | await | new | yield '* ? | '... | <arrow> )*",
    "operand": "(?> <un> ( (?! @object ) @block | <prim_e> ( <post> )* ( '++ | -- ) ? ) ( <asx> )* | yield | <arrow> @block )",
    "bin": "= | '+ | - | '* | / | % | '** | '& | '| | ^ | << | > > > | > > | < | > | <= | >= | == | != | === | !== | && | '|| | ?? | += | -= | *= | /= | %= | **= | &= | |= | ^= | <<= | >>= | >>>= | &&= | ||= | ??= | in | instanceof",
    "chain": "<operand> ( ( <bin> ) <n> <operand> )*+",
    "tern": "<chain> ( '? <n> <chain> ( '? <n> <chain> : <n> <chain> )* : <n> <chain> )*",
    "expr1": "<tern>",
    "seq": "<tern> ( , <n> <tern> )*",
    "expr": "<seq>",
    "args": "( <expr1> ( , <expr1> )* , ? ) ?",
    "array": "( , )* ( <expr1> ( , + <expr1> )* ) ? ( , )*",
    "bind": "( <id> | @objpat | @arrpat ) <bang> ? <ann>",
    "param": "( @ <operand> )* ( <mod> )* ( '... ) ? ( <id> | @objpat | @arrpat | this ) <opt> <ann> ( = <expr1> ) ?",
    "params": "( <param> ( , <param> )* , ? ) ?",
    "patprop": "( <pname> : ( <id> | @objpat | @arrpat ) | <id> ) ( = <expr1> ) ? | '... <id>",
    "objpat": "<n> ( <patprop> ( , <n> <patprop> )* , ? ) ? <n>",
    "patel": "( '... ) ? ( <id> | @objpat | @arrpat ) ( = <expr1> ) ?",
    "arrpat": "( , )* ( <patel> ( , + <patel> )* ) ? ( , )*",
    "meth": "( async | get | set | '* | static )* ( <pname> ) <opt> <tparams> @params <ret>",
    "prop": "<meth> @block | ( <pname> ) : <n> <expr1> | <id> ( = <expr1> ) ? | '... <expr1>",
    "object": "<n> ( <prop> <n> ( , <n> <prop> <n> )* , ? ) ? <n>",
    "catch": "( <id> | @objpat | @arrpat ) <ann>",
    "var": "<bind> = <n> <expr1> | <id> <bang> ? <ann>",
    "bare": "(?! )",
    "vars": "( let | var ) <n> ( <var> ) ( , <n> ( <var> ) )* | const <n> ( <bind> = <n> <expr1> | <bare> ) ( , <n> ( <bind> = <n> <expr1> | <bare> ) )*",
    "for": "( <vars> | <expr> ) ? ; <expr> ? ; <expr> ? | ( ( const | let | var ) ( <id> | @objpat | @arrpat ) | <operand> ) ( of | in ) <expr>",
    "spec": "( type ) ? ( <any_name> | STR ) ( as ( <any_name> | STR ) ) ?",
    "specs": "<n> ( <spec> <n> ( , <n> <spec> <n> )* , ? ) ? <n>",
    "with": "( ( <id> | with ) @object ) ?",
    "import": "import ( type ) ? ( ( <id> , ? ) ? ( '* as <id> | @specs ) ? from ) ? STR <with>",
    "export": "export ( type ? @specs ( from STR <with> ) ? | type ? '* ( as ( <any_name> | STR ) ) ? from STR <with> | default ( <fn> | <cls> ) (?! '. ) | default <expr1> | <vars> | <fnd> | <clsd> )",
    "handled": "catch @catch ? @block <n> ( finally @block ) ? | finally @block",
    "tail": "( try @block <n> ( <handled> ) | switch @expr @swbody | <fnd> (?! '. ) | <clsd> (?! '. ) | @block | export default ? async ? function '* ? <id> ? <tparams> @params <ret> @block | export default ? <cls> )",
    "tsdecl": "(?! )",
    "simple": "<tail> <t> ? | do <n> <stmt> <n> while @expr <t> ? | ( <import> | <export> | <vars> | return ( <seq> ) ? | throw <seq> | ( break | continue ) <id> ? | debugger | <tsdecl> | (?! function | class | async function ) <seq> ) <t> | ; <n>",
    "stmt": "(?> if @expr <n> <stmt> ( <n> else <n> <stmt> ) ? | ( while @expr | for await ? @for | with @expr | <id> : ) <n> <stmt> | (?! @object <t> ? <end> ) ( <simple> ) | @block <t> ? )",
    "block": "[;NL]* ( <stmt> )*+",
    "swbody": "<n> ( (?> ( case <seq> | default ) : <n> | <stmt> ) )*+",
    "member": "(?> [;NL] | ( @ <operand> <n> )* ( <mod> )* ( <meth> ( @block | <sig> ) | static @block | ( static )* ( <pname> ) <opt> <bang> ? <ann> ( = <n> <expr1> ) ? <t> | <tsmember> ) )",
    "sig": "(?! )",
    "tsmember": "(?! )",
    "cbody": "( <member> )*+",
    "unit": "[;NL]* ( <stmt> )*+",
}
TS_RULES = JS_RULES | {
    "atom": "( typeof | keyof | readonly | unique | infer | asserts | new | abstract )* ( ( <id> | this ) is ) ? ( import @args ? ( '. <id> )* <targs> ? | <id> ( '. <any_name> )* <targs> ? | STR | NUM | - NUM | null | void | this | true | false | @objtype | @tuple | @partype | <targs> ? @params => <n> <type> ) ( @tuple | @array )*",
    "union": "( '| | '& ) ? <atom> ( <n> ( '| | '& ) <n> <atom> )*",
    "type": "<union> ( <n> extends <union> <n> '? <n> <union> <n> : <n> <union> ( extends <union> <n> '? <n> <union> <n> : <n> <union> )* ) ?",
    "targs": "< <type> ( , <type> )* , ? >",
    "ann": "( : <type> ) ?",
    "ret": "( : <type> ) ?",
    "opt": "( '? ) ?",
    "tparam": "( const | in | out )* <id> ( extends <type> ) ? ( = <type> ) ?",
    "tparams": "( < <tparam> ( , <tparam> )* , ? > ) ?",
    "gcall": "<targs>",
    "mod": "public | private | protected | readonly | abstract | static | override | declare | async | accessor",
    "asx": "as ( const | <type> ) | satisfies <type>",
    "bang": "!",
    "heritage": "( extends <operand> <targs> ? ) ? ( implements <type> ( , <type> )* ) ?",
    "bare": "<id> : <type>",
    "tuple": "<n> ( ( '... ) ? ( <id> '? ? : ) ? <type> '? ? ( , ( '... ) ? ( <id> '? ? : ) ? <type> '? ? )* , ? ) ?",
    "partype": "<type>",
    "tmeth": "( get | set | new )* ( <pname> ) ? '? ? <tparams> @params <ret>",
    "tmember": "( readonly | '+ | - | <mod> )* ( @mapped '? ? ( - '? ) ? ( : <type> ) ? | ( <pname> ) '? ? <ann> | <tmeth> )",
    "objtype": "<n> ( <tmember> ( , <n> | [;NL]+ ) )* <tmember> ? <n>",
    "mapped": "<id> in <type> ( as <type> ) ? | <id> : <type>",
    "enums": "<n> ( ( <pname> ) ( = <expr1> ) ? <n> ( , <n> ( <pname> ) ( = <expr1> ) ? <n> )* , ? ) ? <n>",
    "sig": "<t>",
    "tsmember": "( readonly | <mod> )* @mapped : <type> <t>",
    "tsdecl": "( export ) ? ( default ) ? ( declare ) ? ( interface <id> <tparams> ( extends <type> ( , <type> )* ) ? @objtype | type <id> <tparams> = <n> <type> | const ? enum <id> @enums | ( namespace | module ) ( <id> ( '. <id> )* | STR ) @block | abstract <cls> | async ? function <id> <tparams> @params <ret> | <cls> | <vars> | import <id> = <expr1> | as namespace <id> | = <expr1> ) | export = <expr1>",
    "import": "import ( type ) ? ( ( <id> , ? ) ? ( '* as <id> | @specs ) ? from ) ? STR <with> | import <id> = <expr1>",
}


class _GoGrammar(Grammar):
    """Go: a line end after a token that can end a statement is a semicolon."""

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        c = self.char
        ends = "".join(c[w] for w in ("ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--")) + ")]}"
        nl, semi = c["NL"], c[";"]
        self._ends = re.compile(f"(?<=[{re.escape(ends)}]){nl}")
        self._nl, self._semi = nl, semi

    def flat(self, text: str) -> str:
        kinds = super().flat(text + "\n")
        kinds = self._ends.sub(self._semi, kinds).replace(self._nl, "")
        begun = kinds.lstrip(self._semi)
        return kinds if not begun or begun.startswith(self.char["package"]) else self.char["ERR"]


class _JsGrammar(Grammar):
    """JavaScript and TypeScript: line ends may close statements, but not before or after an operator."""

    last = ("", "")

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        c = self.char
        nl = c["NL"]
        binary = "= + * / % ** & | ^ ? ?? : => += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= << == != === !== <= >= < > && || , . ?. in instanceof".split()
        after = "".join(c[w] for w in [*binary, "-", "!", "~", "typeof", "new", "..."])
        before = "".join(c[w] for w in binary if w not in ("<", "*"))
        self._drop = re.compile(f"(?<=[{re.escape(after)}({{[]){nl}+|{nl}+(?=[{re.escape(before)})\\]])")
        self._more = re.compile(f"{nl}{{2,}}")
        self._nl = nl

    def flat(self, text: str) -> str:
        if text == _JsGrammar.last[0]:  # JavaScript and TypeScript have the same tokens
            return _JsGrammar.last[1]
        _JsGrammar.last = (text, self._flat(text))
        return _JsGrammar.last[1]

    def _flat(self, text: str) -> str:
        if text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        return self._more.sub(self._nl, self._drop.sub("", super().flat(text)))

    def inside(self, bracket: str, content: str) -> str:
        return content.replace(self._nl, "") if bracket != "{" else content.strip(self._nl) if self._nl in content else content


def _js_rules(rules: dict[str, str]) -> dict[str, str]:
    return {k: re.sub(r"\[;NL\]([*+]?)", lambda m: f"( ; | NL ) {m[1]}".rstrip(), v) for k, v in rules.items()}


_JS_REGEX = r"(?:(?<=[(,=:\[!&|?{};\n+\-*%<>~^])|(?<=[(,=:\[!&|?{};+\-*%<>~^] )|(?<=return ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_TEMPLATE = r"`(?:\\.|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`"
_JS_TOKENS = "|".join([r"//[^\n]*", _BLOCK_COMMENT, _JS_REGEX, _TEMPLATE, _STRING, _CHAR, _NUM, r"(?:[^\W\d]|\$)(?:\w|\$)*", _ops(_JS_OPS), r"[()\[\]{}]", r"\n", r"\S"])


def _jsx_out(text: str) -> str:
    """``text`` with markup elements replaced by ``null``; embedded expressions must be balanced."""
    out, at = [], 0
    for m in _JSX_START.finditer(text):
        if m.start(1) < at:
            continue
        end = _jsx_end(text, m.start(1))
        if end < 0:
            return text
        out += [text[at : m.start(1)], "null"]
        at = end
    return "".join([*out, text[at:]])


_JSX_START = re.compile(r"(?:[(=,?:>&|{\[]|\breturn)\s*(<(?:[A-Za-z][\w.]*[\s/>]|>))")
_JSX_TAG = re.compile(r"""<(/?)([\w.:-]*)((?:\s+(?:[\w:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}))?|\{(?:[^{}]|\{[^{}]*\})*\}))*)\s*(/?)>""")
_JSX_TEXT = re.compile(r"(?:[^<{}>]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*")


def _jsx_end(text: str, at: int) -> int:
    names: list[str] = []
    while True:
        m = _JSX_TAG.match(text, at)
        if not m:
            return -1
        if m[1]:
            if not names or names.pop() != m[2]:
                return -1
        elif not m[4]:
            names.append(m[2])
        at = m.end()
        if not names:
            return at
        at = _JSX_TEXT.match(text, at).end()


class Languages:
    """Checks of the supported languages; grammars are compiled when first used."""

    names = ("python", "typescript", "javascript", "rust", "go", "java", "c")

    def __init__(self) -> None:
        self._made: dict[str, Grammar] = {}

    def grammar(self, name: str) -> Grammar:
        if name not in self._made:
            self._made[name] = _BUILD[name]()
        return self._made[name]

    def fits(self, name: str, text: str, markup: bool = True, early: bool = False) -> bool:
        """Does ``text`` fit the grammar of ``name``? ``markup``: elements are allowed (.jsx, .tsx, .js).

        ``early`` looks at the opening first, which is cheaper where a text most likely does not fit.
        """
        if name == "python":
            return python_fits(text)
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "\0" in text:
            return False
        g = self.grammar(name)
        elements = markup and name in ("javascript", "typescript") and ("</" in text or "/>" in text) and _JSX_START.search(text) is not None
        if early and not elements and not g.may_fit(text):
            return False
        if g.fits(text):
            return True
        if name == "c" and _BRANCH.search(text) and g.fits(first_branches(text)):
            return True
        return elements and g.fits(_jsx_out(text))


_BRANCH = re.compile(r"^[ \t]*#[ \t]*(?:else|elif)\b", re.M)
_CONDITION = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b")


def first_branches(text: str) -> str:
    """``text`` with only the first branch of each preprocessor condition; later branches become blank lines."""
    out, hidden = [], []
    for line in text.split("\n"):
        m = _CONDITION.match(line)
        if m and m[1].startswith("if"):
            hidden.append(False)
        elif m and hidden:
            if m[1] == "endif":
                hidden.pop()
            else:
                hidden[-1] = True
        out.append("" if any(hidden) else line)
    return "\n".join(out)


def python_fits(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text.removeprefix("\ufeff"), "x", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


#: A modifier that stands twice, or two of access, without an annotation between them.
_MODIFIERS = "public private protected static final abstract synchronized native transient volatile strictfp"
_TWICE = f"({{{_MODIFIERS}}}){{{_MODIFIERS}}}*\\1|{{public private protected}}{{{_MODIFIERS}}}*{{public private protected}}"


def _java() -> Grammar:
    keywords = "sealed when yield package import static public private protected final abstract synchronized native default volatile transient strictfp class interface enum record extends implements throws throw new return if else while for do try catch finally switch case break continue assert instanceof this super true false null goto const " + _JAVA_PRIM
    text_block = r'"""(?:[^\\]|\\.)*?"""'
    tokens = "|".join([r"//[^\n]*", _BLOCK_COMMENT, text_block, _STRING, _CHAR, _NUM, r"(?:[^\W\d]|\$)(?:\w|\$)*", _ops(_JAVA_OPS), r"[()\[\]{}]", r"\S"])
    groups = {"(": ["args", "annargs", "cast", "params", "lparams", "expr", "for", "res", "catch"], "[": ["index"], "{": ["block", "cbody", "ebody", "init", "swbody"]}
    return _Dropping(tokens, keywords, _JAVA_OPS, JAVA_RULES, groups, "unit", {"block": ("<stmt>", ""), "cbody": ("<member>", ""), "swbody": ("<caselabel> ( : | -> <expr> ; | -> ) | <stmt>", ""), "unit": ("<ann> * package <name> ; | import static ? <name> ( '. '* ) ? ; | ; | <class>", "")}, never=_TWICE)


class _Dropping(Grammar):
    """A language in which line ends mean nothing."""

    def flat(self, text: str) -> str:
        return super().flat(text).replace(self.char["NL"], "")


def _c() -> Grammar:
    keywords = "PREPROC asm __asm__ __asm __volatile__ typedef struct union enum sizeof typeof __attribute__ if else while for do switch case default break continue goto return " + _C_PRIM + " " + _C_QUAL
    directive = r"(?:(?<=\n)|(?<![\s\S]))[ \t]*#[ \t]*(?:(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|error|warning|pragma|line|ident|import)\b|\d+ \")(?:[^\n\\]|\\.|/\*.*?\*/)*"
    tokens = "|".join([r"//[^\n]*", _BLOCK_COMMENT, directive, r'(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"', r"[uUL]?'(?:[^'\\\n]|\\.)*'", _NUM, _NAME, _ops(_C_OPS), r"[()\[\]{}]", r"\S"])
    groups = {"(": ["args", "type", "params", "declr_g", "expr", "for", "asmbody"], "[": ["index"], "{": ["block", "sbody", "ebody", "init", "ctop"]}
    rules = {k: v.replace("@declr ", "@declr_g ").replace("@declr)", "@declr_g)") for k, v in C_RULES.items()}
    return _Dropping(tokens, keywords, _C_OPS, rules, groups, "unit", {"block": ("<stmt>", "( <label> )*"), "sbody": ("<field>", ""), "ctop": ("<top>", ""), "init": ("<initem> ,", "<initem> ?"), "unit": ("<top>", "")})


def _go() -> Grammar:
    keywords = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
    tokens = "|".join([r"//[^\n]*", _BLOCK_COMMENT, r"`[^`]*`", _STRING, _CHAR, _NUM, _NAME, _ops(_GO_OPS), r"[()\[\]{}]", r"\n", r"\S"])
    groups = {"(": ["args", "params", "partype", "tassert", "expr", "vgroup", "tgroup", "imports"], "[": ["index", "arr", "slice", "targs"], "{": ["block", "sbody", "ibody", "lit", "swbody"]}
    return _GoGrammar(tokens, keywords, _GO_OPS, GO_RULES, groups, "unit", {"block": ("<stmt> ;", "<stmt> ?"), "lit": ("<litem> ,", "<litem> ? ; ?"), "unit": ("; | package <id> ; | import ( <impspec> | @imports ) ; | ( <fn> | <gen> ) ;", "( <fn> | <gen> ) ?")})


def _rust() -> Grammar:
    keywords = "LIFETIME as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while yield auto default macro_rules _"
    comment = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
    raw = "(?=b?r[#\"])(?:" + "|".join(rf'b?r{"#" * n}".*?"{"#" * n}' for n in range(9)) + ")"
    tokens = "|".join([r"//[^\n]*", comment, raw, r'[bc]?"(?:[^"\\]|\\.)*"', r"b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'", r"'[^\W\d]\w*", r"r#[^\W\d]\w*", _NUM, _NAME, _ops(_RUST_OPS), r"[()\[\]{}]", r"\S"])
    groups = {"(": ["args", "tytuple", "ptuple", "params", "tfields"], "[": ["array", "pslice"], "{": ["block", "slit", "pstruct", "arms", "fields", "variants", "ibody", "utrees"]}
    rules = {k: v.replace("@index", "@array").replace("@pargs", "@ptuple").replace("@mod", "@ibody") for k, v in RUST_RULES.items()}
    return _Dropping(tokens, keywords, _RUST_OPS, rules, groups, "unit", {"block": ("<stmt>", "<expr> ?"), "ibody": ("<item> | <attr> | <mac> ; ?", ""), "unit": ("<item> | <attr> | <mac> ; ?", "")}, always=True)


def _js(ts: bool) -> Grammar:
    rules = _js_rules(TS_RULES if ts else JS_RULES)
    groups = {"(": ["args", "params", "expr", "for", "catch"], "[": ["array", "arrpat"], "{": ["block", "object", "objpat", "cbody", "specs", "swbody"]}
    if ts:
        groups["("].append("partype")
        groups["["] += ["tuple", "mapped"]
        groups["{"] += ["objtype", "enums"]
    return _JsGrammar(_JS_TOKENS, f"with {_JS_KW} {_JS_CTX} {_TS_CTX}", _JS_OPS, rules, groups, "unit", {m: (i, "") for m, i in (("block", "; | NL | <stmt>"), ("unit", "; | NL | <stmt>"), ("cbody", "<member>"), ("swbody", "( case <seq> | default ) : | ; | NL | <stmt>"))} | ({"objtype": ("<tmember> ( , NL * | ( ; | NL )+ )", "<tmember> ?")} if ts else {}))


_BUILD = {"java": _java, "c": _c, "go": _go, "rust": _rust, "javascript": lambda: _js(False), "typescript": lambda: _js(True)}
