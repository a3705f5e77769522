"""Syntax checker for JavaScript, Flow-typed JavaScript, TypeScript and TSX.

Statements are parsed by recursive descent, expressions by precedence climbing.  An error
ends the statement it stands in; the parser then skips to a synchronising token (panic mode)
and goes on, so that one file yields all of its errors.  Only grammar is checked: names,
types and duplicate declarations are not looked at.
"""

from __future__ import annotations

import re
import sys


def room_for(text: str) -> None:
    """Lets the descent go as deep as a text can nest.  Frames of Python functions lie on the heap (some 2 kB a
    bracket), so nesting is bounded by the length of the text alone."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12_000 + 12 * len(text)))


JS, FLOW, TS, TSX = "js", "flow", "ts", "tsx"

_ID_START = r"[A-Za-z_$\u00aa-\ud7ff\uf900-\ufefe\U00010000-\U0003ffff]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\}"
_ID_PART = r"[\w$\u200c\u200d\u00b7]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\}"
_NAME = rf"(?:{_ID_START})(?:{_ID_PART})*+"
_ESCAPE = r"\\(?:\r\n|u\{[0-9A-Fa-f]{1,6}\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[^ux])"
_NUM = (
    r"(?:0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*)n?"
    r"|(?:0|[1-9](?:_?[0-9])*)n"
    r"|(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?"
)
_PUNC = (
    r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--"
    r"|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
)
_WS = r"((?:[ \t\n\r\v\f\u00a0\ufeff\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000]++|//[^\n\r\u2028\u2029]*+|/\*(?s:.*?)\*/)*+)"
_TOKEN = re.compile(
    _WS
    + rf"(?:({_NAME})|({_PUNC.replace('|/=', '|/=', 1)})"
    + rf"|(\"(?:[^\"\\\n\r]++|{_ESCAPE})*+\"|'(?:[^'\\\n\r]++|{_ESCAPE})*+')"
    + rf"|((?:{_NUM})(?![\w$\\]))|(`)|(#(?:{_NAME}))|(\Z)|(.))",
    re.S,
)
# A "." before a digit starts a number, so the number goes first there.
_DOTNUM = re.compile(r"\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9]+)?(?![\w$])")
NAME, PUNC, STR, NUM, TMPL, PRIV, EOF, BAD = 2, 3, 4, 5, 6, 7, 8, 9
REGEX, TEXT = 10, 11
_TMPL_PART = re.compile(r"(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+(`|\$\{)", re.S)
_BAD_TMPL_ESC = re.compile(r"(?<!\\)(?:\\\\)*\\(?:u(?![0-9A-Fa-f]{4}|\{[0-9A-Fa-f]{1,6}\})|x(?![0-9A-Fa-f]{2})|[1-9]|0[0-9])")
_REGEX = re.compile(r"/(?![*/])((?:[^/\\\[\n\r\u2028\u2029]++|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r]++|\\[^\n\r])*+\])++)/([\w$]*)")
_JSX_TEXT = re.compile(r"[^{}<>]*+")
_JSX_NAME = re.compile(_WS + rf"((?:{_ID_START})(?:{_ID_PART}|-)*+)")
_JSX_STR = re.compile(_WS + r"(\"[^\"]*+\"|'[^']*+')")
_AFTER_LT = re.compile(_WS + r"(.?)", re.S)

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if"
    " import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_BIN = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8,
    ">=": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_UNARY_WORDS = frozenset(("typeof", "void", "delete"))
_MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor in out get set".split())
_SYNC = frozenset("break class const continue debugger do export for function if import let return switch throw try var while".split())
_FLAGS = re.compile(r"(?!.*(.).*\1)(?!.*u.*v)(?!.*v.*u)[dgimsuvy]*\Z")


class SyntaxFault(Exception):
    """An error at a place in the text."""

    def __init__(self, at: int, what: str):
        self.at, self.what = at, what


_regex_ok: dict[str, bool] = {}


def regex_is_valid(body: str, flags: str) -> bool:
    """Whether a regular-expression literal is well formed: flags, groups, classes and quantifiers."""
    key = flags + "/" + body
    if (known := _regex_ok.get(key)) is not None:
        return known
    ok = _regex_check(body, flags)
    if len(_regex_ok) < 5_000:
        _regex_ok[key] = ok
    return ok


def _regex_check(body: str, flags: str) -> bool:
    if not _FLAGS.match(flags):
        return False
    strict = "u" in flags or "v" in flags
    i, n, depth, can_repeat = 0, len(body), 0, False
    while i < n:
        c = body[i]
        if c == "\\":
            i += 2
            can_repeat = body[i - 1 : i] not in "bB"
            continue
        if c == "[":
            level = 0
            while i < n:
                if body[i] == "\\":
                    i += 1
                elif body[i] == "[" and (level == 0 or "v" in flags):
                    level += 1
                elif body[i] == "]":
                    level -= 1
                    if level <= 0:
                        break
                i += 1
            else:
                return False
            can_repeat = True
        elif c == "(":
            depth += 1
            can_repeat = False
            if body[i + 1 : i + 2] == "?":
                m = re.compile(r"\(\?(?::|=|!|<=|<!|<[\w$]+>|[ims]*(?:-[ims]+)?:)").match(body, i)
                if not m:
                    return False
                i = m.end() - 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
            can_repeat = True
        elif c in "*+?":
            if not can_repeat:
                return False
            if body[i + 1 : i + 2] == "?":
                i += 1
            can_repeat = False
        elif c == "{":
            m = re.compile(r"\{(\d+)(?:,(\d*))?\}\??").match(body, i)
            if m:
                if not can_repeat or (m[2] and int(m[2]) < int(m[1])):
                    return False
                i = m.end() - 1
                can_repeat = False
            elif strict:
                return False
            else:
                can_repeat = True
        elif strict and c in "}]":
            return False
        else:
            can_repeat = c not in "^|"
        i += 1
    return depth == 0


class Parser:
    """One parse of one text in one dialect.  ``errors`` holds (offset, message) in order."""

    def __init__(self, text: str, dialect: str):
        self.s, self.errors = text, []
        self.ts = dialect in (TS, TSX)
        self.flow = dialect == FLOW
        self.types = self.ts or self.flow
        self.jsx = dialect != TS
        self.fn = self.is_async = self.is_gen = False
        self.loop = self.switch = 0
        self.cover = None
        self.not_arrow: set[int] = set()
        self.no_cond_arrow = False
        self.ambient = 0
        self.no_cond_type = False
        self.prev_end = 0
        self.k = self.v = None
        self.start = self.end = 0
        self.nl = False
        pos = 1 if text[:1] == "\ufeff" else 0
        if text.startswith("#!", pos):
            m = re.compile(r"[^\n\r]*").match(text, pos)
            pos = m.end()
        self.begin = pos

    # ---- tokens
    def read(self, pos: int) -> None:
        m = _TOKEN.match(self.s, pos)
        k = m.lastindex
        ws = m[1]
        self.nl = ("\n" in ws or "\r" in ws or "\u2028" in ws) if ws else False
        self.k, self.v, self.start, self.end = k, m[k], m.start(k), m.end()
        if k == PUNC:
            if self.v == "." and (d := _DOTNUM.match(self.s, self.start)):
                self.k, self.v, self.end = NUM, d[0], d.end()
        elif k == EOF:
            self.v = None
        elif k == BAD or k == STR and False:
            self.v = m[k]

    def next(self) -> None:
        self.prev_end = self.end
        m = _TOKEN.match(self.s, self.end)
        k = m.lastindex
        ws = m[1]
        self.nl = ("\n" in ws or "\r" in ws or "\u2028" in ws) if ws else False
        self.k, self.v, self.start, self.end = k, m[k], m.start(k), m.end()
        if k == PUNC:
            if self.v == "." and (d := _DOTNUM.match(self.s, self.start)):
                self.k, self.v, self.end = NUM, d[0], d.end()
        elif k == EOF:
            self.v = None

    def save(self):
        return (self.k, self.v, self.start, self.end, self.nl, self.prev_end, self.cover)

    def back(self, state) -> None:
        self.k, self.v, self.start, self.end, self.nl, self.prev_end, self.cover = state

    def fail(self, what: str = ""):
        if self.k == EOF:
            raise SyntaxFault(self.start, "unexpected end of file")
        if self.k == BAD:
            c = self.v
            if c in "\"'":
                raise SyntaxFault(self.start, "unterminated or malformed string")
            if self.s.startswith("/*", self.start):
                raise SyntaxFault(self.start, "unterminated comment")
            raise SyntaxFault(self.start, "malformed number" if c.isdigit() else "stray character")
        if self.k == PUNC and self.v == "/" and self.s.startswith("/*", self.start):
            raise SyntaxFault(self.start, "unterminated comment")
        raise SyntaxFault(self.start, what or f"unexpected {self.v[:20]!r}")

    def is_p(self, v: str) -> bool:
        return self.v == v and self.k == PUNC

    def is_n(self, v: str) -> bool:
        return self.v == v and self.k == NAME

    def eat(self, v: str) -> bool:
        if self.v == v and self.k == PUNC:
            self.next()
            return True
        return False

    def eat_n(self, v: str) -> bool:
        if self.v == v and self.k == NAME:
            self.next()
            return True
        return False

    def expect(self, v: str) -> None:
        if self.v == v and self.k == PUNC:
            self.next()
        else:
            self.fail(f"expected {v!r}" + (f", found {self.v[:20]!r}" if self.v else ""))

    def expect_n(self, v: str) -> None:
        if self.v == v and self.k == NAME:
            self.next()
        else:
            self.fail(f"expected {v!r}")

    def expect_gt(self) -> None:
        if self.k == PUNC and self.v[0] == ">":
            if len(self.v) > 1:
                self.end = self.start + 1
                self.v = ">"
            self.next()
        else:
            self.fail("expected '>'")

    def semicolon(self) -> None:
        if self.k == PUNC and self.v == ";":
            self.next()
        elif not (self.nl or self.k == EOF or (self.v == "}" and self.k == PUNC)):
            self.fail()

    def peek(self):
        """Kind, text and line break before the token after the current one."""
        m = _TOKEN.match(self.s, self.end)
        return m.lastindex, m[m.lastindex], "\n" in m[1]

    def ident(self) -> None:
        if self.k != NAME or self.v in RESERVED:
            self.fail()
        self.next()

    # ---- program
    def program(self) -> list[tuple[int, str]]:
        self.end = self.begin
        self.next()
        while self.k != EOF:
            at = self.start
            try:
                self.statement(True)
            except SyntaxFault as e:
                self.errors.append((e.at, e.what))
                self.recover(at)
        return self.errors

    def recover(self, began: int) -> None:
        """Skip to the next statement: past a semicolon or closing brace, or to a keyword at the start of a line."""
        self.fn = self.is_async = self.is_gen = self.no_cond_arrow = False
        self.loop = self.switch = self.ambient = 0
        self.cover = None
        depth = 0
        if self.start <= began and self.k != EOF:
            self.next()
        while self.k != EOF:
            if self.k == PUNC:
                if self.v == ";" and depth <= 0:
                    self.next()
                    return
                if self.v in "{([":
                    depth += 1
                elif self.v in "})]":
                    depth -= 1
                    if depth <= 0 and self.v == "}":
                        self.next()
                        return
            elif self.k == NAME and self.nl and depth <= 0 and self.v in _SYNC:
                return
            self.next()

    # ---- statements
    def statement(self, decl: bool = False) -> None:
        k, v = self.k, self.v
        if k == PUNC:
            if v == "{":
                self.block()
                return
            if v == ";":
                self.next()
                return
            if v == "@":
                self.decorators()
                if self.is_n("export"):
                    self.export()
                else:
                    self.eat_n("abstract")
                    self.class_(True)
                return
            self.expression_statement()
            return
        if k != NAME:
            self.expression_statement()
            return
        f = _STATEMENTS.get(v)
        if f is not None:
            if f(self, decl) is not False:
                return
        elif self.types and v in _TYPE_STATEMENTS and self.type_statement(v):
            return
        if v not in RESERVED:
            n = self.peek()
            if n[0] == PUNC and n[1] == ":":
                self.next()
                self.next()
                if self.is_n("function") or not (self.k == NAME and self.v in ("class", "const", "import", "export")):
                    self.statement()
                else:
                    self.fail()
                return
        self.expression_statement()

    def expression_statement(self) -> None:
        self.expression()
        self.semicolon()

    def block(self) -> None:
        self.expect("{")
        while not (self.v == "}" and self.k == PUNC):
            if self.k == EOF:
                self.fail()
            self.statement(True)
        self.next()

    def st_var(self, decl) -> None:
        kind = self.v
        self.next()
        if kind == "const" and self.is_n("enum") and self.ts:
            self.enum_()
            return
        if not decl and kind == "const":
            self.fail("lexical declaration in a single-statement context")
        self.var_list(kind, True)
        self.semicolon()

    def st_let(self, decl):
        n = self.peek()
        if (n[0] == NAME and (n[1] not in RESERVED) and n[1] not in ("of", "in", "instanceof")) or (n[0] == PUNC and n[1] in ("[", "{")):
            if n[0] == NAME and not decl and n[2]:
                return False
            self.next()
            self.var_list("let", True)
            self.semicolon()
            return None
        return False

    def var_list(self, kind: str, use_in: bool) -> int:
        count = 0
        while True:
            pattern = self.k == PUNC
            self.binding_target()
            typed = False
            if self.types:
                if self.ts and self.is_p("!") and not self.nl:
                    self.next()
                    typed = True
                    if not self.is_p(":"):
                        self.fail()
                if self.eat(":"):
                    self.type_()
            count += 1
            if self.eat("="):
                self.assign(use_in)
            elif use_in and not self.ambient and not typed and (kind == "const" or pattern):
                self.fail("missing initialiser")
            if not self.eat(","):
                return count

    def binding_target(self) -> None:
        if self.k == NAME:
            if self.v in RESERVED:
                self.fail()
            self.next()
        elif self.is_p("["):
            self.next()
            while not self.is_p("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding_target()
                if not rest and self.eat("="):
                    self.assign(True)
                if not self.is_p("]"):
                    if rest:
                        self.fail()
                    self.expect(",")
            self.next()
        elif self.is_p("{"):
            self.next()
            while not self.is_p("}"):
                if self.eat("..."):
                    self.ident()
                    if not self.is_p("}"):
                        self.fail()
                    break
                name = self.k == NAME and self.v not in RESERVED
                self.property_name()
                if self.eat(":"):
                    self.binding_target()
                elif not name:
                    self.fail()
                if self.eat("="):
                    self.assign(True)
                if not self.is_p("}"):
                    self.expect(",")
            self.expect("}")
        else:
            self.fail()

    def st_function(self, decl) -> None:
        self.next()
        self.function_rest(False, True)

    def function_rest(self, is_async: bool, declaration: bool, name_optional: bool = False) -> None:
        gen = self.eat("*")
        if self.k == NAME and not self.is_p("("):
            if self.v in RESERVED:
                self.fail()
            self.next()
        elif declaration and not name_optional:
            self.fail()
        self.function_tail(is_async, gen, declaration)

    def function_tail(self, is_async: bool, gen: bool, may_lack_body: bool = False) -> None:
        old = self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow, self.cover
        self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow = True, is_async, gen, 0, 0, False
        if self.types and self.is_p("<"):
            self.type_params()
        self.params()
        if self.types and self.eat(":"):
            self.return_type()
        if self.is_p("{"):
            self.block()
        elif may_lack_body and self.types and (self.ts or self.ambient):
            self.semicolon()
        else:
            self.fail("expected '{'")
        self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow, self.cover = old

    def params(self) -> None:
        self.expect("(")
        while not self.is_p(")"):
            if self.is_p("@"):
                self.decorators()
            rest = self.eat("...")
            if self.ts:
                while self.k == NAME and self.v in ("public", "private", "protected", "readonly", "override"):
                    n = self.peek()
                    if n[0] == NAME or (n[0] == PUNC and n[1] in "{["):
                        self.next()
                    else:
                        break
            if self.types and self.is_n("this"):
                self.next()
            else:
                self.binding_target()
            if self.types:
                self.eat("?")
                if self.eat(":"):
                    self.type_()
            if not rest and self.eat("="):
                self.assign(True)
            if not self.is_p(")"):
                if rest and not self.ambient:
                    self.fail()
                self.expect(",")
        self.next()

    def return_type(self) -> None:
        if self.ts and self.is_n("asserts"):
            n = self.peek()
            if n[0] == NAME and not n[2] and n[1] not in ("is",):
                self.next()
                self.next()
                if self.eat_n("is"):
                    self.type_()
                return
        if self.k == NAME:
            n = self.peek()
            if n[0] == NAME and n[1] == "is" and not n[2]:
                self.next()
                self.next()
                self.type_()
                return
        if self.flow and self.eat("%"):
            self.expect_n("checks")
            return
        self.type_()
        if self.flow and self.is_p("%"):
            self.next()
            self.expect_n("checks")

    def st_async(self, decl):
        n = self.peek()
        if n[0] == NAME and n[1] == "function" and not n[2]:
            self.next()
            self.next()
            self.function_rest(True, True)
            return None
        return False

    def st_class(self, decl) -> None:
        self.class_(True)

    def decorators(self) -> None:
        while self.eat("@"):
            if self.is_p("("):
                self.next()
                self.expression()
                self.expect(")")
            else:
                self.ident()
                while self.eat("."):
                    if self.k not in (NAME, PRIV):
                        self.fail()
                    self.next()
                if self.ts and self.is_p("<"):
                    self.type_args()
                if self.is_p("("):
                    self.arguments()

    def class_(self, declaration: bool, name_optional: bool = False) -> None:
        self.expect_n("class")
        if self.k == NAME and self.v not in ("extends",) and not (self.v == "implements" and self.types):
            self.ident()
        elif declaration and not name_optional:
            self.fail()
        if self.types and self.is_p("<"):
            self.type_params()
        if self.eat_n("extends"):
            self.lhs()
            if self.types and self.is_p("<"):
                self.type_args()
            if self.flow and self.is_n("mixins"):
                self.next()
                self.type_()
        if self.types and self.eat_n("implements"):
            self.type_()
            while self.eat(","):
                self.type_()
        self.expect("{")
        while not (self.v == "}" and self.k == PUNC):
            if self.k == EOF:
                self.fail()
            if self.eat(";"):
                continue
            self.member()
        self.next()

    def member(self) -> None:
        if self.is_p("@"):
            self.decorators()
        is_async = gen = accessor = abstract = static = False
        key_read = False
        while self.k == NAME and self.v in _MODIFIERS:
            word = self.v
            if word not in ("static", "async", "get", "set", "accessor") and not self.types:
                break
            n = self.peek()
            if n[0] == PUNC and n[1] in ("(", "=", ";", "}", ",", ":", "?", "!", "<") or n[0] == EOF:
                break
            if n[2] and word in ("async", "get", "set", "accessor", "declare", "abstract"):
                break
            if word == "static" and n[0] == PUNC and n[1] == "{":
                self.next()
                old = self.fn, self.is_async, self.is_gen, self.loop, self.switch
                self.fn, self.is_async, self.is_gen, self.loop, self.switch = False, False, False, 0, 0
                self.block()
                self.fn, self.is_async, self.is_gen, self.loop, self.switch = old
                return
            if n[0] == PUNC and n[1] not in ("[", "*", "#") and not (self.flow and n[1] in "+-"):
                break
            self.next()
            is_async |= word == "async"
            accessor |= word in ("get", "set")
            abstract |= word in ("abstract", "declare")
            static |= word == "static"
            if accessor:
                break
        if self.flow and self.k == PUNC and self.v in ("+", "-"):
            self.next()
        if self.eat("*"):
            gen = True
        if self.types and self.is_p("[") and self.index_signature():
            self.semicolon()
            return
        if self.k == PRIV:
            self.next()
        else:
            self.property_name()
        if self.types:
            if self.eat("?"):
                pass
            elif self.is_p("!") and self.ts:
                self.next()
        if self.is_p("(") or (self.types and self.is_p("<")):
            self.function_tail(is_async, gen, self.ts or bool(self.ambient))
            if self.ambient:
                self.eat(";")
            return
        if gen or is_async or (accessor and not self.ambient):
            self.fail()
        if self.types and self.eat(":"):
            self.type_()
        if self.is_p("="):
            self.next()
            old = self.fn, self.is_async, self.is_gen
            self.fn, self.is_async, self.is_gen = True, False, False
            self.assign(True)
            self.fn, self.is_async, self.is_gen = old
        if self.flow and self.ambient and self.eat(","):
            return
        self.semicolon()

    def index_signature(self) -> bool:
        state = self.save()
        self.next()
        if self.flow:
            try:
                if self.k == NAME and self.peek()[:2] == (PUNC, ":"):
                    self.next()
                    self.next()
                self.type_()
                self.expect("]")
                if self.is_p(":"):
                    self.next()
                    self.type_()
                    return True
            except SyntaxFault:
                pass
            self.back(state)
            return False
        if self.k == NAME:
            self.next()
            if self.eat(":"):
                self.type_()
                self.expect("]")
                if self.eat(":"):
                    self.type_()
                return True
        self.back(state)
        return False

    def property_name(self) -> None:
        if self.k in (NAME, STR, NUM):
            self.next()
        elif self.is_p("["):
            self.next()
            self.assign(True)
            self.expect("]")
        else:
            self.fail()

    def st_if(self, decl) -> None:
        self.next()
        self.paren()
        self.statement()
        if self.is_n("else"):
            self.next()
            self.statement()

    def paren(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def body(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    def st_while(self, decl) -> None:
        self.next()
        self.paren()
        self.body()

    def st_do(self, decl) -> None:
        self.next()
        self.body()
        self.expect_n("while")
        self.paren()
        self.eat(";")

    def st_for(self, decl) -> None:
        self.next()
        is_await = False
        if self.is_n("await"):
            self.next()
            is_await = True
        self.expect("(")
        if self.eat(";"):
            self.for_rest()
            return
        v = self.v
        if self.k == NAME and (v in ("var", "const") or (v == "let" and not (self.peek()[0] == NAME and self.peek()[1] in ("in", "of")))):
            self.next()
            if v == "const" and self.is_n("using"):
                self.next()
            begun = self.start
            state = self.save()
            count = self.var_list(v, False)
            if self.k == NAME and self.v in ("of", "in"):
                word = self.v
                if count != 1:
                    self.fail()
                self.next()
                if word == "of":
                    self.assign(True)
                else:
                    self.expression()
                self.expect(")")
                self.body()
                return
            del begun
            if v == "const":  # initialisers are needed in this form
                here = self.save()
                self.back(state)
                self.var_list(v, True)
                self.back(here)
        else:
            self.cover = None
            state = self.save()
            try:
                kind = self.lhs_or_pattern()
            except SyntaxFault:
                self.back(state)
                kind = None
            if kind and self.k == NAME and self.v in ("of", "in"):
                if kind not in ("id", "member", "obj", "arr"):
                    self.fail()
                word = self.v
                self.cover = None
                self.next()
                if word == "of":
                    self.assign(True)
                else:
                    self.expression()
                self.expect(")")
                self.body()
                return
            self.back(state)
            self.expression(False)
        if is_await:
            self.fail()
        self.expect(";")
        self.for_rest()

    def lhs_or_pattern(self):
        return self.postfix()

    def for_rest(self) -> None:
        if not self.is_p(";"):
            self.expression()
        self.expect(";")
        if not self.is_p(")"):
            self.expression()
        self.expect(")")
        self.body()

    def st_return(self, decl) -> None:
        if not self.fn:
            self.fail("return outside a function")
        self.next()
        if not (self.nl or self.k == EOF or (self.k == PUNC and self.v in (";", "}"))):
            self.expression()
        self.semicolon()

    def st_break(self, decl) -> None:
        word = self.v
        self.next()
        if self.k == NAME and not self.nl and self.v not in RESERVED:
            self.next()
        elif not self.loop and not (word == "break" and self.switch):
            raise SyntaxFault(self.start, f"{word} outside a loop")
        self.semicolon()

    def st_throw(self, decl) -> None:
        self.next()
        if self.nl:
            self.fail("line break after throw")
        self.expression()
        self.semicolon()

    def st_try(self, decl) -> None:
        self.next()
        self.block()
        had = False
        if self.eat_n("catch"):
            had = True
            if self.eat("("):
                self.binding_target()
                if self.types and self.eat(":"):
                    self.type_()
                self.expect(")")
            self.block()
        if self.eat_n("finally"):
            had = True
            self.block()
        if not had:
            self.fail("try without catch or finally")

    def st_switch(self, decl) -> None:
        self.next()
        self.paren()
        self.expect("{")
        self.switch += 1
        default = False
        while not self.is_p("}"):
            if self.eat_n("case"):
                self.expression()
            elif self.is_n("default") and not default:
                self.next()
                default = True
            else:
                self.fail()
            self.expect(":")
            while not (self.k == PUNC and self.v == "}" or self.k == NAME and self.v in ("case", "default")):
                if self.k == EOF:
                    self.fail()
                self.statement(True)
        self.next()
        self.switch -= 1

    def st_with(self, decl) -> None:
        self.next()
        self.paren()
        self.statement()

    def st_debugger(self, decl) -> None:
        self.next()
        self.semicolon()

    def st_bad(self, decl) -> None:
        self.fail()

    # ---- modules
    def module_name(self) -> None:
        if self.k == STR:
            self.next()
        else:
            if self.k != NAME:
                self.fail()
            self.next()

    def from_(self) -> None:
        if self.k != STR:
            self.fail("expected a module name")
        self.next()
        if (self.is_n("with") or (self.is_n("assert") and not self.nl)) and self.peek()[:2] == (PUNC, "{"):
            self.next()
            self.object()

    def st_import(self, decl):
        n = self.peek()
        if n[0] == PUNC and n[1] in ("(", "."):
            return False
        if not decl or (self.fn and not self.ambient):
            self.fail("import below the top level")
        self.next()
        if self.k == STR:
            self.from_()
            self.semicolon()
            return None
        if self.k == NAME and self.v in (("type", "typeof") if self.types else ()) or self.is_n("defer"):
            n = self.peek()
            if (n[0] == NAME and (n[1] != "from")) or (n[0] == PUNC and n[1] in ("{", "*")):
                self.next()
            elif n[0] == NAME and n[1] == "from":
                state = self.save()
                self.next()
                self.next()
                again = self.is_n("from")
                self.back(state)
                if again:
                    self.next()
        more = True
        if self.k == NAME:
            self.ident()
            if self.ts and self.is_p("="):
                self.next()
                if self.is_n("require") and self.peek()[:2] == (PUNC, "("):
                    self.next()
                    self.next()
                    if self.k != STR:
                        self.fail()
                    self.next()
                    self.expect(")")
                else:
                    self.ident()
                    while self.eat("."):
                        self.ident()
                self.semicolon()
                return None
            more = self.eat(",")
        if more:
            if self.eat("*"):
                self.expect_n("as")
                self.ident()
            elif self.is_p("{"):
                self.specifiers(True)
            else:
                self.fail()
        self.expect_n("from")
        self.from_()
        self.semicolon()
        return None

    def specifiers(self, importing: bool) -> bool:
        """Returns whether every local name may be a binding (needed when no source follows)."""
        plain = True
        self.expect("{")
        while not self.is_p("}"):
            if self.types and self.k == NAME and self.v in ("type", "typeof"):
                n = self.peek()
                if n[0] in (NAME, STR) and n[1] != "as":
                    self.next()
                elif n[1] == "as" and n[0] == NAME:
                    state = self.save()
                    self.next()
                    self.next()
                    if self.k == NAME and self.v == "as" or self.is_p(",") or self.is_p("}"):
                        self.back(state)
                        self.next() if not (self.v == "type" and self.k == NAME and False) else None
                        # "type as" names an export called as
                        if self.k == NAME and self.v == "as":
                            self.next()
                            if self.eat_n("as"):
                                self.module_name()
                            if not self.is_p("}"):
                                self.expect(",")
                            continue
                    else:
                        self.back(state)
            word = self.v if self.k == NAME else None
            if self.k == STR or (word in RESERVED and word != "default"):
                plain = False
            elif word == "default" :
                plain = plain and False
            self.module_name()
            if self.eat_n("as"):
                if importing:
                    self.ident()
                else:
                    self.module_name()
            elif importing and (word is None or word in RESERVED):
                self.fail()
            if not self.is_p("}"):
                self.expect(",")
        self.next()
        return plain

    def export(self) -> None:
        self.next()
        if self.eat("*"):
            if self.eat_n("as"):
                self.module_name()
            self.expect_n("from")
            self.from_()
            self.semicolon()
            return
        if self.is_p("{"):
            plain = self.specifiers(False)
            if self.eat_n("from"):
                self.from_()
            elif not plain:
                self.fail("expected 'from'")
            self.semicolon()
            return
        if self.eat_n("default"):
            if self.is_p("@"):
                self.decorators()
            if self.is_n("function"):
                self.next()
                self.function_rest(False, True, True)
            elif self.is_n("async") and self.peek()[:3] == (NAME, "function", False):
                self.next()
                self.next()
                self.function_rest(True, True, True)
            elif self.is_n("class"):
                self.class_(True, True)
            elif self.ts and self.is_n("abstract") and self.peek()[:2] == (NAME, "class"):
                self.next()
                self.class_(True, True)
            elif self.ts and self.is_n("interface") and self.peek()[0] == NAME:
                self.type_statement("interface")
            else:
                self.assign(True)
                self.check_cover()
                self.semicolon()
            return
        if self.types:
            if self.ts and self.eat("="):
                self.expression()
                self.semicolon()
                return
            if self.ts and self.is_n("as") and self.peek()[1] == "namespace":
                self.next()
                self.next()
                self.ident()
                self.semicolon()
                return
            if self.ts and self.is_n("import"):
                self.st_import(True)
                return
            if self.is_n("type"):
                n = self.peek()
                if n[0] == PUNC and n[1] in ("{", "*"):
                    self.next()
                    if self.eat("*"):
                        if self.eat_n("as"):
                            self.module_name()
                        self.expect_n("from")
                        self.from_()
                    else:
                        self.specifiers(False)
                        if self.eat_n("from"):
                            self.from_()
                    self.semicolon()
                    return
            if self.k == NAME and self.v in _TYPE_STATEMENTS and self.type_statement(self.v):
                return
        if self.is_p("@"):
            self.decorators()
        if self.k == NAME and self.v in ("var", "let", "const", "function", "class", "async"):
            if self.v == "let":
                if self.st_let(True) is False:
                    self.fail()
            elif self.v == "async":
                if self.st_async(True) is False:
                    self.fail()
            else:
                _STATEMENTS[self.v](self, True)
            return
        self.fail()

    def st_export(self, decl) -> None:
        if not decl or self.fn and not self.ambient:
            self.fail("export below the top level")
        self.export()

    # ---- type-level statements
    def type_statement(self, word: str) -> bool:
        n = self.peek()
        if word == "interface" and n[0] == NAME and not n[2]:
            self.next()
            self.ident()
            if self.is_p("<"):
                self.type_params()
            if self.eat_n("extends"):
                self.type_()
                while self.eat(","):
                    self.type_()
            self.object_type()
            return True
        if word in ("type", "opaque") and n[0] == NAME and not n[2] and n[1] not in RESERVED:
            self.next()
            if word == "opaque":
                self.expect_n("type")
            self.ident()
            if self.is_p("<"):
                self.type_params()
            if self.flow and self.eat(":"):
                self.type_()
            if self.ambient and word == "opaque" and not self.is_p("="):
                self.semicolon()
                return True
            self.expect("=")
            self.type_()
            self.semicolon()
            return True
        if word == "declare" and n[0] == NAME and not n[2]:
            self.next()
            self.ambient += 1
            if self.flow and self.is_n("export"):
                self.next()
                if self.eat_n("default"):
                    if self.is_n("class") or self.is_n("function"):
                        self.statement(True)
                    else:
                        self.type_()
                        self.semicolon()
                elif self.is_p("*") or self.is_p("{"):
                    if self.eat("*"):
                        pass
                    else:
                        self.specifiers(False)
                    if self.eat_n("from"):
                        self.from_()
                    self.semicolon()
                else:
                    self.statement(True)
            elif self.flow and self.is_n("module") and self.peek()[:2] == (PUNC, "."):
                self.next()
                self.next()
                self.next()
                self.expect(":")
                self.type_()
                self.semicolon()
            elif self.is_n("global"):
                self.next()
                self.block()
            elif self.flow and self.is_n("function"):
                self.next()
                self.ident()
                if self.is_p("<"):
                    self.type_params()
                self.params_or_types()
                if self.eat(":"):
                    self.return_type()
                self.semicolon()
            elif self.flow and (self.is_n("var") or self.is_n("let") or self.is_n("const")):
                self.next()
                self.ident()
                if self.eat(":"):
                    self.type_()
                self.semicolon()
            elif self.flow and self.is_n("class"):
                self.next()
                self.ident()
                if self.is_p("<"):
                    self.type_params()
                if self.eat_n("extends"):
                    self.type_()
                if self.eat_n("mixins"):
                    self.type_()
                self.object_type()
            else:
                self.statement(True)
            self.ambient -= 1
            return True
        if self.ts:
            if word == "enum":
                self.enum_()
                return True
            if word == "abstract" and n[0] == NAME and n[1] == "class" and not n[2]:
                self.next()
                self.class_(True)
                return True
            if word in ("namespace", "module") and not n[2] and (n[0] == NAME or (word == "module" and n[0] == STR)):
                self.next()
                if self.k == STR:
                    self.next()
                    if not self.is_p("{"):
                        self.semicolon()
                        return True
                else:
                    self.ident()
                    while self.eat("."):
                        self.ident()
                old, self.fn = self.fn, False
                self.block()
                self.fn = old
                return True
        return False

    def params_or_types(self) -> None:
        state = self.save()
        try:
            self.params()
        except SyntaxFault:
            self.back(state)
            self.function_type_params()

    def enum_(self) -> None:
        self.expect_n("enum")
        self.ident()
        self.expect("{")
        while not self.is_p("}"):
            self.property_name()
            if self.eat("="):
                self.assign(True)
            if not self.is_p("}"):
                self.expect(",")
        self.next()

    # ---- types
    def type_params(self) -> None:
        self.expect("<")
        while not (self.k == PUNC and self.v[0] == ">"):
            while self.ts and self.k == NAME and self.v in ("const", "in", "out") and self.peek()[0] == NAME and self.peek()[1] not in ("extends",):
                self.next()
            if self.flow and self.k == PUNC and self.v in ("+", "-"):
                self.next()
            self.ident()
            if self.flow and self.eat(":"):
                self.type_()
            if self.eat_n("extends"):
                self.type_()
            if self.eat("="):
                self.type_()
            if not self.is_p(">"):
                if self.k == PUNC and self.v[0] == ">":
                    break
                self.expect(",")
        self.expect_gt()

    def type_args(self) -> None:
        if self.k == PUNC and self.v == "<<":
            self.end = self.start + 1
            self.v = "<"
        self.expect("<")
        if self.k == PUNC and self.v == ">" and self.flow:
            self.next()
            return
        while True:
            self.type_()
            if self.eat(","):
                if self.flow and self.k == PUNC and self.v[0] == ">":
                    break
                continue
            break
        self.expect_gt()

    def type_(self) -> None:
        if self.k == NAME and self.v == "abstract" and self.peek()[:2] == (NAME, "new"):
            self.next()
        if self.is_n("new") and self.ts:
            self.next()
            if self.is_p("<"):
                self.type_params()
            self.function_type_params()
            self.expect("=>")
            self.return_type()
            return
        if self.is_p("<"):
            self.type_params()
            self.function_type_params()
            self.expect("=>")
            self.return_type()
            return
        if self.is_p("(") and not (self.flow and self.no_flow_arrow) and self.try_function_type():
            return
        self.eat("|") or self.eat("&")
        self.union_type()
        if self.flow and self.is_p("=>") and not self.nl and not self.no_flow_arrow:
            self.next()
            self.return_type()
            return
        if self.ts and self.is_n("extends") and not self.nl and not self.no_cond_type:
            self.next()
            old, self.no_cond_type = self.no_cond_type, True
            self.type_()
            self.no_cond_type = old
            self.expect("?")
            old, self.no_cond_type = self.no_cond_type, False
            self.type_()
            self.expect(":")
            self.type_()
            self.no_cond_type = old

    no_flow_arrow = False

    def try_function_type(self) -> bool:
        state = self.save()
        try:
            self.function_type_params()
            if not self.is_p("=>"):
                raise SyntaxFault(self.start, "")
        except SyntaxFault:
            self.back(state)
            return False
        self.next()
        self.return_type()
        return True

    def function_type_params(self) -> None:
        self.expect("(")
        old, self.no_cond_type = self.no_cond_type, False
        flag, self.no_flow_arrow = self.no_flow_arrow, False
        while not self.is_p(")"):
            self.eat("...")
            if self.flow:
                if self.k == NAME and (n := self.peek())[0] == PUNC and n[1] in (":", "?"):
                    self.next()
                    self.eat("?")
                    self.expect(":")
                self.type_()
            else:
                if self.is_n("this"):
                    self.next()
                else:
                    self.binding_target()
                self.eat("?")
                if self.eat(":"):
                    self.type_()
            if not self.is_p(")"):
                self.expect(",")
        self.next()
        self.no_cond_type = old
        self.no_flow_arrow = flag

    def union_type(self) -> None:
        while True:
            self.unary_type()
            if self.k == PUNC and self.v in ("|", "&"):
                self.next()
                if self.is_p("(") and self.try_function_type():
                    return
                continue
            return

    def unary_type(self) -> None:
        if self.flow and self.eat("?"):
            if self.is_p("(") and self.try_function_type():
                return
            self.unary_type()
            return
        if self.k == NAME and self.ts:
            v = self.v
            if v in ("keyof", "unique", "readonly"):
                n = self.peek()
                if n[0] in (NAME, STR) or (n[0] == PUNC and n[1] in ("(", "[", "{")) or n[0] == TMPL:
                    if not (n[0] == NAME and n[1] in ("extends", "is", "as", "in")):
                        self.next()
                        self.unary_type()
                        return
            elif v == "infer":
                n = self.peek()
                if n[0] == NAME and n[1] != "extends":
                    self.next()
                    self.ident()
                    if self.is_n("extends"):
                        state = self.save()
                        try:
                            self.next()
                            old, self.no_cond_type = self.no_cond_type, True
                            self.type_()
                            self.no_cond_type = old
                            if self.is_p("?") and not self.no_cond_type:
                                raise SyntaxFault(self.start, "")
                        except SyntaxFault:
                            self.no_cond_type = old
                            self.back(state)
                    return
        if self.flow and self.k == NAME and self.v in ("keyof",) and self.peek()[0] == NAME:
            self.next()
            self.unary_type()
            return
        self.primary_type()
        while self.k == PUNC:
            if self.v == "[" and not self.nl:
                self.next()
                if not self.eat("]"):
                    self.type_()
                    self.expect("]")
            elif self.flow and self.v == "?." and self.peek()[1] == "[":
                self.next()
                self.next()
                self.type_()
                self.expect("]")
            else:
                return

    def primary_type(self) -> None:
        k, v = self.k, self.v
        if k == NAME:
            if v == "typeof":
                self.next()
                if self.is_n("import"):
                    self.primary_type()
                    return
                if self.k != NAME:
                    self.fail()
                self.next()
                while self.is_p("."):
                    self.next()
                    if self.k not in (NAME, PRIV):
                        self.fail()
                    self.next()
                if self.is_p("<") and not self.nl:
                    self.type_args()
                return
            if v == "import" and self.ts:
                self.next()
                self.expect("(")
                self.type_()
                if self.eat(","):
                    if self.is_p("{"):
                        self.object()
                self.expect(")")
                while self.eat("."):
                    self.next()
                if self.is_p("<"):
                    self.type_args()
                return
            if v in ("void", "null", "this", "true", "false"):
                self.next()
                return
            if self.flow and v == "interface" and self.peek()[:2] == (PUNC, "{"):
                self.next()
                self.object_type()
                return
            if v in RESERVED:
                self.fail()
            self.next()
            while self.is_p("."):
                self.next()
                if self.k != NAME:
                    self.fail()
                self.next()
            if self.k == PUNC and self.v in ("<", "<<") and not self.nl:
                self.type_args()
            return
        if k in (STR, NUM):
            self.next()
            return
        if k == TMPL:
            self.template(True)
            return
        if k == PUNC:
            if v == "-":
                self.next()
                if self.k != NUM:
                    self.fail()
                self.next()
                return
            if v == "{":
                self.object_type()
                return
            if v == "[":
                self.next()
                while not self.is_p("]"):
                    self.eat("...")
                    if self.k == NAME and (n := self.peek())[0] == PUNC and (n[1] == ":" or (n[1] == "?" and self.labelled())):
                        self.next()
                        self.eat("?")
                        self.expect(":")
                    self.type_()
                    self.eat("?")
                    if not self.is_p("]"):
                        self.expect(",")
                self.next()
                return
            if v == "(":
                self.next()
                old, self.no_cond_type = self.no_cond_type, False
                flag, self.no_flow_arrow = self.no_flow_arrow, False
                self.type_()
                self.no_cond_type = old
                self.no_flow_arrow = flag
                self.expect(")")
                return
            if v == "*" and self.flow:
                self.next()
                return
        self.fail()

    def labelled(self) -> bool:
        state = self.save()
        self.next()
        self.next()
        yes = self.is_p(":")
        self.back(state)
        return yes

    def object_type(self) -> None:
        self.expect("{")
        exact = self.flow and self.eat("|")
        old, self.no_cond_type = self.no_cond_type, False
        flag, self.no_flow_arrow = self.no_flow_arrow, False
        while not self.is_p("}"):
            if exact and (self.is_p("|") or self.is_p("||")):
                break
            if self.k == EOF:
                self.fail()
            self.type_member()
            if self.k == PUNC and self.v in (",", ";"):
                self.next()
            elif not (self.is_p("}") or exact and self.is_p("|") or self.ts and self.nl):
                self.fail()
        if exact:
            self.expect("|")
        self.next()
        self.no_cond_type = old
        self.no_flow_arrow = flag

    def type_member(self) -> None:
        if self.flow and self.eat("..."):
            if not (self.k == PUNC and self.v in ("}", ",", ";", "|")):
                self.type_()
            return
        if self.is_p("(") or self.is_p("<"):
            self.signature()
            return
        if self.ts and self.is_n("new") and (n := self.peek())[0] == PUNC and n[1] in ("(", "<"):
            self.next()
            self.signature()
            return
        if self.k == PUNC and self.v in ("+", "-"):
            self.next()
            if self.ts:
                self.expect_n("readonly")
        while self.k == NAME and self.v in ("readonly", "get", "set", "static", "proto"):
            n = self.peek()
            if n[0] in (NAME, STR, NUM) or n[0] == PUNC and n[1] == "[" and (self.v == "readonly" or self.v in ("get", "set")):
                self.next()
            else:
                break
        if self.flow and self.k == PUNC and self.v in ("+", "-"):
            self.next()
        if self.is_p("["):
            if self.ts:
                n = self.peek()
                if n[0] == NAME:
                    state = self.save()
                    self.next()
                    self.next()
                    if self.is_p(":"):
                        self.next()
                        self.type_()
                        self.expect("]")
                        if self.eat(":"):
                            self.type_()
                        return
                    if self.is_n("in"):
                        self.next()
                        self.type_()
                        if self.eat_n("as"):
                            self.type_()
                        self.expect("]")
                        if self.k == PUNC and self.v in ("+", "-"):
                            self.next()
                        self.eat("?")
                        if self.eat(":"):
                            self.type_()
                        return
                    self.back(state)
            else:
                self.next()
                if self.is_p("["):
                    self.next()
                    self.ident()
                    self.expect("]")
                    self.expect("]")
                    self.eat("?")
                    if self.is_p("("):
                        self.signature()
                        return
                    self.expect(":")
                    self.type_()
                    return
                if self.k == NAME and self.peek()[:2] == (PUNC, ":"):
                    self.next()
                    self.next()
                self.type_()
                self.expect("]")
                self.expect(":")
                self.type_()
                return
        if self.k == PRIV:
            self.fail()
        self.property_name()
        self.eat("?")
        if self.is_p("(") or self.is_p("<"):
            self.signature()
        elif self.eat(":"):
            self.type_()
        elif self.flow:
            self.fail()

    def signature(self) -> None:
        if self.is_p("<"):
            self.type_params()
        self.function_type_params()
        if self.eat(":"):
            self.return_type()
        elif self.flow and self.eat("=>"):
            self.return_type()

    # ---- expressions
    def check_cover(self) -> None:
        if self.cover is not None:
            raise SyntaxFault(self.cover, "initialiser in an object literal")

    def expression(self, use_in: bool = True) -> str:
        old, self.cover = self.cover, None
        kind = self.assign(use_in)
        if self.v == "," and self.k == PUNC:
            kind = "seq"
            while self.eat(","):
                self.assign(use_in)
        if self.cover is not None:
            self.check_cover()
        self.cover = old
        return kind

    def assign(self, use_in: bool = True) -> str:
        k, v = self.k, self.v
        if k == PUNC:
            if v == "(" and self.start not in self.not_arrow and self.try_arrow(False):
                return "arrow"
            if v == "<" and self.types:
                if self.ts and not self.jsx or self.generic_arrow_ahead():
                    if self.try_arrow(False):
                        return "arrow"
        elif k == NAME:
            if v == "async":
                n = self.peek()
                if not n[2]:
                    if n[0] == NAME and n[1] not in RESERVED and n[1] not in ("of", "in", "as", "satisfies"):
                        state = self.save()
                        self.next()
                        self.next()
                        if self.is_p("=>") and not self.nl:
                            self.arrow_body(True, use_in)
                            return "arrow"
                        self.back(state)
                    elif n[0] == PUNC and n[1] in ("(", "<") and self.start not in self.not_arrow and (n[1] == "(" or self.types):
                        at, state = self.start, self.save()
                        self.next()
                        if self.try_arrow(True):
                            return "arrow"
                        self.back(state)
                        self.not_arrow.add(at)
            elif v == "yield" and self.is_gen:
                self.next()
                star = self.is_p("*") and not self.nl
                if star:
                    self.next()
                if star or not (self.nl or self.k == EOF or (self.k == PUNC and self.v in (")", "]", "}", ",", ";", ":")) or (self.k == NAME and self.v in ("in", "of"))):
                    self.assign(use_in)
                return "other"
            if v not in RESERVED:
                n = self.peek()
                if n[0] == PUNC and n[1] == "=>" and not n[2]:
                    if not (v == "await" and self.is_async):
                        self.next()
                        self.arrow_body(False, use_in)
                        return "arrow"
        old, self.cover = self.cover, None
        kind = self.conditional(use_in)
        if self.k == PUNC and self.v in _ASSIGN:
            if self.v == "=":
                if kind in ("obj", "arr"):
                    self.cover = None
                elif kind not in ("id", "member", "cast"):
                    self.fail("invalid assignment target")
            elif kind not in ("id", "member", "cast"):
                self.fail("invalid assignment target")
            self.next()
            self.assign(use_in)
            kind = "other"
        elif self.cover is not None and kind not in ("obj", "arr"):
            self.check_cover()
        if old is not None:
            self.cover = old
        return kind

    def generic_arrow_ahead(self) -> bool:
        """In a dialect with both JSX and types, whether '<' starts type parameters."""
        m = re.compile(rf"<\s*(?:const\s+)?{_NAME}\s*(,|extends\b|=(?!>)|:|>\s*\()").match(self.s, self.start)
        return bool(m) and (m[1] in (",",) or m[1] == "extends" and not re.compile(rf"<\s*{_NAME}\s+extends\s*[=>/]").match(self.s, self.start) or self.flow or m[1] == "=" and False)

    def try_arrow(self, is_async: bool) -> bool:
        at, state = self.start, self.save()
        errors = len(self.errors)
        typed = False
        old = self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow
        try:
            if self.is_p("<"):
                self.type_params()
            self.no_cond_arrow = False
            self.params()
            if self.types and self.is_p(":"):
                self.next()
                typed = True
                self.no_flow_arrow, flag = True, self.no_flow_arrow
                try:
                    self.return_type()
                finally:
                    self.no_flow_arrow = flag
            if not self.is_p("=>") or self.nl:
                raise SyntaxFault(self.start, "")
        except SyntaxFault:
            self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow = old
            del self.errors[errors:]
            self.back(state)
            self.not_arrow.add(at)
            return False
        self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow = old
        if typed and self.no_cond_arrow:
            # a ? (b) : c => d  - the typed reading holds only if a ':' still follows
            try:
                self.arrow_body(is_async, True)
                if self.is_p(":"):
                    return True
            except SyntaxFault:
                pass
            self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow = old
            self.back(state)
            self.not_arrow.add(at)
            return False
        self.cover = state[6]
        self.arrow_body(is_async, True)
        return True

    def arrow_body(self, is_async: bool, use_in: bool) -> None:
        self.expect("=>")
        old = self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow
        if self.is_p("{"):
            self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow = True, is_async, False, 0, 0, False
            self.block()
        else:
            self.fn, self.is_async, self.is_gen = True, is_async, False
            was, self.cover = self.cover, None
            self.assign(use_in)
            self.check_cover()
            self.cover = was
        self.fn, self.is_async, self.is_gen, self.loop, self.switch, self.no_cond_arrow = old

    def conditional(self, use_in: bool) -> str:
        kind = self.binary(0, use_in)
        if self.v == "?" and self.k == PUNC:
            self.next()
            old, self.no_cond_arrow = self.no_cond_arrow, self.types
            self.assign(True)
            self.no_cond_arrow = old
            self.expect(":")
            self.assign(use_in)
            return "other"
        return kind

    def binary(self, least: int, use_in: bool) -> str:
        if self.k == PRIV:
            self.next()
            if not self.is_n("in"):
                self.fail()
            kind = "other"
        else:
            kind = self.unary()
        while True:
            k, v = self.k, self.v
            if k == PUNC:
                p = _BIN.get(v)
                if p is None or p <= least and not (v == "**" and p == least):
                    return kind
                if v == "**":
                    if kind == "unary":
                        self.fail("unary operator before '**'")
                    self.next()
                    self.binary(11, use_in)
                    kind = "other"
                    continue
                self.next()
                right = self.binary(p, use_in)
                if p <= 3:
                    mine = "nullish" if p == 1 else "logic"
                    other = "logic" if p == 1 else "nullish"
                    if kind == other or right == other:
                        raise SyntaxFault(self.prev_end, "'??' mixed with '||' or '&&'")
                    kind = mine
                else:
                    kind = "other"
            elif k == NAME:
                if v == "instanceof" or (v == "in" and use_in):
                    if least >= 8:
                        return kind
                    self.next()
                    self.binary(8, use_in)
                    kind = "other"
                elif self.types and v in ("as", "satisfies") and not self.nl and (self.ts or v == "as"):
                    if least >= 8:
                        return kind
                    self.next()
                    if self.is_n("const"):
                        self.next()
                    else:
                        self.type_()
                    kind = "cast"
                else:
                    return kind
            else:
                return kind

    def unary(self) -> str:
        k, v = self.k, self.v
        if k == PUNC:
            if v in ("!", "-", "+", "~"):
                self.next()
                self.unary()
                return "unary"
            if v in ("++", "--"):
                self.next()
                kind = self.unary()
                if kind not in ("id", "member", "cast"):
                    self.fail("invalid operand of an update")
                return "other"
            if v == "<" and self.ts and not self.jsx:
                self.next()
                if self.is_n("const"):
                    self.next()
                else:
                    self.type_()
                self.expect_gt()
                self.unary()
                return "cast"
        elif k == NAME:
            if v in _UNARY_WORDS:
                self.next()
                self.unary()
                return "unary"
            if v == "await" and (self.is_async or not self.fn):
                n = self.peek()
                if self.is_async or not (n[0] == PUNC and n[1] in (")", ",", ";", "=", ".", "]", "}", ":", "?", "=>")):
                    self.next()
                    self.unary()
                    return "unary"
        kind = self.postfix()
        if self.k == PUNC and self.v in ("++", "--") and not self.nl:
            if kind not in ("id", "member", "cast"):
                self.fail("invalid operand of an update")
            self.next()
            return "other"
        return kind

    def lhs(self) -> str:
        return self.postfix()

    def postfix(self) -> str:
        k, v = self.k, self.v
        if k == NAME and v not in RESERVED:
            if v == "async" and self.peek()[:3] == (NAME, "function", False):
                self.next()
                self.next()
                self.function_rest(True, False)
                kind = "other"
            else:
                self.next()
                kind = "id"
        else:
            kind = self.primary()
            if kind == "arrow":
                return kind
        optional = False
        while True:
            k, v = self.k, self.v
            if k == PUNC:
                if v == ".":
                    self.next()
                    if self.k != NAME and self.k != PRIV:
                        self.fail()
                    self.next()
                    kind = "other" if optional else "member"
                elif v == "(":
                    self.arguments()
                    kind = "call"
                elif v == "[":
                    self.next()
                    old, self.no_cond_arrow = self.no_cond_arrow, False
                    self.expression()
                    self.no_cond_arrow = old
                    self.expect("]")
                    kind = "other" if optional else "member"
                elif v == "?.":
                    self.next()
                    optional = True
                    if self.is_p("("):
                        self.arguments()
                    elif self.is_p("["):
                        self.next()
                        self.expression()
                        self.expect("]")
                    elif self.types and self.is_p("<"):
                        self.type_args()
                        self.arguments()
                    elif self.k in (NAME, PRIV):
                        self.next()
                    else:
                        self.fail()
                    kind = "other"
                elif v == "!" and self.ts and not self.nl:
                    self.next()
                elif v in ("<", "<<") and self.types and kind in ("id", "member", "call", "other") and self.call_type_args():
                    kind = "call"
                else:
                    return kind
            elif k == TMPL:
                if optional:
                    self.fail()
                self.template(False, True)
                kind = "call"
            else:
                return kind

    def call_type_args(self) -> bool:
        state = self.save()
        try:
            self.type_args()
            if self.is_p("(") or self.k == TMPL:
                return True
            # an instantiation expression
            if self.ts and (self.nl or self.k == EOF or (self.k == PUNC and self.v in (")", "]", "}", ",", ";", ":", "==", "===", "!=", "!==", "&&", "||", "??", "?", "."))):
                return True
        except SyntaxFault:
            pass
        self.back(state)
        return False

    def arguments(self) -> None:
        self.expect("(")
        old, self.no_cond_arrow = self.no_cond_arrow, False
        while not (self.v == ")" and self.k == PUNC):
            self.eat("...")
            was, self.cover = self.cover, None
            self.assign(True)
            if self.cover is not None:
                self.check_cover()
            self.cover = was
            if not (self.v == ")" and self.k == PUNC):
                self.expect(",")
        self.next()
        self.no_cond_arrow = old

    def primary(self) -> str:
        k, v = self.k, self.v
        if k in (STR, NUM):
            self.next()
            return "other"
        if k == TMPL:
            self.template(False)
            return "other"
        if k == PUNC:
            if v == "(":
                self.next()
                old, self.no_cond_arrow = self.no_cond_arrow, False
                kind = self.expression()
                if self.flow and self.eat(":"):
                    self.type_()
                    kind = "cast"
                self.expect(")")
                self.no_cond_arrow = old
                return kind if kind in ("id", "member", "cast") else "other"
            if v == "[":
                self.next()
                old, self.no_cond_arrow = self.no_cond_arrow, False
                while not (self.v == "]" and self.k == PUNC):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assign(True)
                    if not (self.v == "]" and self.k == PUNC):
                        self.expect(",")
                self.next()
                self.no_cond_arrow = old
                return "arr"
            if v == "{":
                self.object()
                return "obj"
            if v == "<" and self.jsx:
                self.jsx_element()
                self.next()
                return "other"
            if v in ("/", "/="):
                m = _REGEX.match(self.s, self.start)
                if not m:
                    self.fail("unterminated regular expression" if not self.s.startswith("/*", self.start) else "")
                if not regex_is_valid(m[1], m[2]):
                    self.fail("malformed regular expression")
                self.end = m.end()
                self.next()
                return "other"
            if v == "@":
                self.decorators()
                self.class_(False)
                return "other"
            self.fail()
        if k == NAME:
            if v == "function":
                self.next()
                self.function_rest(False, False)
                return "other"
            if v == "class":
                self.class_(False)
                return "other"
            if v == "new":
                return self.new()
            if v in ("this", "null", "true", "false"):
                self.next()
                return "other"
            if v == "super":
                self.next()
                if not (self.k == PUNC and self.v in ("(", ".", "[")):
                    self.fail()
                return "other"
            if v == "import":
                self.next()
                if self.eat("."):
                    if self.k != NAME:
                        self.fail()
                    self.next()
                    return "other"
                if not self.is_p("("):
                    self.fail()
                return "other"
        self.fail()
        return ""

    def new(self) -> str:
        self.next()
        if self.eat("."):
            self.expect_n("target")
            return "other"
        if self.is_n("new"):
            self.new()
        elif self.is_n("import"):
            self.fail()
        elif self.k == NAME and self.v not in RESERVED:
            self.next()
        else:
            self.primary()
        while True:
            if self.is_p("."):
                self.next()
                if self.k not in (NAME, PRIV):
                    self.fail()
                self.next()
            elif self.is_p("["):
                self.next()
                self.expression()
                self.expect("]")
            elif self.ts and self.is_p("!") and not self.nl:
                self.next()
            elif self.k == TMPL:
                self.template(False, True)
            elif self.types and self.is_p("<"):
                if not self.call_type_args():
                    break
            elif self.is_p("?."):
                self.fail()
            else:
                break
        if self.is_p("("):
            self.arguments()
        return "other"

    def template(self, in_type: bool, tagged: bool = False) -> None:
        pos = self.end
        while True:
            m = _TMPL_PART.match(self.s, pos)
            if not m:
                raise SyntaxFault(self.start, "unterminated template")
            if not tagged and "\\" in m[0] and _BAD_TMPL_ESC.search(m[0]):
                raise SyntaxFault(m.start(), "malformed escape in a template")
            if m[1] == "`":
                self.end = m.end()
                self.next()
                return
            self.end = m.end()
            self.next()
            if in_type:
                self.type_()
            else:
                old, self.no_cond_arrow = self.no_cond_arrow, False
                self.expression()
                self.no_cond_arrow = old
            if not self.is_p("}"):
                self.fail("expected '}'")
            pos = self.end

    def object(self) -> None:
        self.expect("{")
        old, self.no_cond_arrow = self.no_cond_arrow, False
        while not (self.v == "}" and self.k == PUNC):
            if self.eat("..."):
                self.assign(True)
            else:
                self.object_member()
            if not (self.v == "}" and self.k == PUNC):
                self.expect(",")
        self.next()
        self.no_cond_arrow = old

    def object_member(self) -> None:
        is_async = gen = accessor = False
        while self.k == NAME and self.v in ("async", "get", "set"):
            n = self.peek()
            if n[0] == PUNC and n[1] in (",", ":", "(", "}", "=", "<") or n[0] == EOF:
                break
            if self.v == "async" and n[2]:
                self.fail()
            is_async |= self.v == "async"
            accessor |= self.v != "async"
            self.next()
            break
        if self.eat("*"):
            gen = True
        k, v, at = self.k, self.v, self.start
        self.property_name()
        if self.is_p("(") or (self.types and self.is_p("<")):
            self.function_tail(is_async, gen)
            return
        if gen or is_async or accessor:
            self.fail()
        if self.eat(":"):
            self.assign(True)
            return
        if k != NAME or v in RESERVED:
            self.fail()
        if self.is_p("="):
            at = self.start
            self.next()
            was, self.cover = self.cover, None
            self.assign(True)
            self.cover = was if was is not None else at

    # ---- JSX
    def jsx_name(self, pos: int) -> tuple[str, int]:
        m = _JSX_NAME.match(self.s, pos)
        if not m:
            raise SyntaxFault(pos, "malformed tag")
        name, pos = m[2], m.end()
        while (m := _AFTER_LT.match(self.s, pos)) and m[2] in (".", ":") and m[2]:
            n = _JSX_NAME.match(self.s, m.end())
            if not n:
                raise SyntaxFault(pos, "malformed tag")
            name += m[2] + n[2]
            pos = n.end()
        return name, pos

    def jsx_element(self) -> None:
        """Parse from the '<' of the current token; self.end is left after the element."""
        s = self.s
        pos = self.start + 1
        stack: list[str] = []
        while True:
            # an opening tag or fragment begins at pos (after '<')
            m = _AFTER_LT.match(s, pos)
            closed = False
            if m[2] == ">":
                stack.append("")
                pos = m.end()
            else:
                name, pos = self.jsx_name(pos)
                pos, closed = self.jsx_attributes(pos)
                if not closed:
                    stack.append(name)
            while True:
                if not stack:
                    self.end = pos
                    return
                m = _JSX_TEXT.match(s, pos)
                pos = m.end()
                c = s[pos : pos + 1]
                if c == "{":
                    pos = self.jsx_braces(pos, True)
                elif c == "<":
                    m = _AFTER_LT.match(s, pos + 1)
                    if m[2] == "/":
                        pos = m.end()
                        m = _AFTER_LT.match(s, pos)
                        if m[2] == ">":
                            name, pos = "", m.end()
                        else:
                            name, pos = self.jsx_name(pos)
                            m = _AFTER_LT.match(s, pos)
                            if m[2] != ">":
                                raise SyntaxFault(pos, "malformed closing tag" if m[2] else "unexpected end of file")
                            pos = m.end()
                        if name != stack.pop():
                            raise SyntaxFault(pos, "closing tag does not match")
                    else:
                        pos += 1
                        break
                elif c == "":
                    raise SyntaxFault(pos, "unexpected end of file")
                else:
                    raise SyntaxFault(pos, f"{c!r} in the text of an element")

    def jsx_braces(self, pos: int, child: bool) -> int:
        """'{' stands at pos; returns the place after the matching '}'."""
        self.end = pos + 1
        old, self.no_cond_arrow = self.no_cond_arrow, False
        self.next()
        if self.is_p("}"):
            if not child:
                self.fail("empty attribute")
        else:
            if self.is_p("..."):
                self.next()
                self.assign(True)
            else:
                self.expression()
            if not self.is_p("}"):
                self.fail("expected '}'")
        self.no_cond_arrow = old
        return self.end

    def jsx_attributes(self, pos: int) -> tuple[int, bool]:
        s = self.s
        if self.types:
            m = _AFTER_LT.match(s, pos)
            if m[2] == "<":
                self.end = pos
                self.next()
                # the '>' that ends the arguments is consumed with one token of lookahead
                self.type_args()
                pos = self.prev_end
        while True:
            m = _AFTER_LT.match(s, pos)
            c = m[2]
            if c == ">":
                return m.end(), False
            if c == "/":
                m = _AFTER_LT.match(s, m.end())
                if m[2] != ">":
                    raise SyntaxFault(pos, "malformed tag")
                return m.end(), True
            if c == "{":
                self.end = m.end() - 1
                self.next()
                if self.peek()[1] != "...":
                    raise SyntaxFault(self.start, "expected a spread")
                pos = self.jsx_braces(self.start, False)
                continue
            if not c:
                raise SyntaxFault(pos, "unexpected end of file")
            _, pos = self.jsx_name(pos)
            m = _AFTER_LT.match(s, pos)
            if m[2] == "=":
                pos = m.end()
                if t := _JSX_STR.match(s, pos):
                    pos = t.end()
                else:
                    m = _AFTER_LT.match(s, pos)
                    if m[2] == "{":
                        pos = self.jsx_braces(m.end() - 1, False)
                    elif m[2] == "<":
                        self.end = m.end() - 1
                        self.next()
                        self.jsx_element()
                        pos = self.end
                    else:
                        raise SyntaxFault(pos, "malformed attribute")


_TYPE_STATEMENTS = frozenset("interface type opaque declare enum abstract namespace module".split())
_STATEMENTS = {
    "var": Parser.st_var, "const": Parser.st_var, "let": Parser.st_let, "function": Parser.st_function, "async": Parser.st_async,
    "class": Parser.st_class, "if": Parser.st_if, "for": Parser.st_for, "while": Parser.st_while, "do": Parser.st_do,
    "return": Parser.st_return, "break": Parser.st_break, "continue": Parser.st_break, "throw": Parser.st_throw,
    "try": Parser.st_try, "switch": Parser.st_switch, "with": Parser.st_with, "debugger": Parser.st_debugger,
    "import": Parser.st_import, "export": Parser.st_export, "case": Parser.st_bad, "default": Parser.st_bad,
    "else": Parser.st_bad, "catch": Parser.st_bad, "finally": Parser.st_bad,
}


def check(text: str, dialect: str) -> list[tuple[int, str]]:
    """All syntax errors of a text, as (offset, message); empty if it is valid."""
    room_for(text)
    return Parser(text, dialect).program()
