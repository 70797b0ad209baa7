"""Facts about Python sources as one long table, one parse a file.

A file that does not parse, or nests too deeply to be read, gives one row of kind "error" and nothing else; an
empty or null text gives no row. What a kind keeps in which column:

=========  ==================  ==========================  ============================  ===================================
kind       name                mode                        detail                        other
=========  ==================  ==========================  ============================  ===================================
import     full module         import or from              top-level module              names: symbols, value: level
alias      local name          original name               full module                   value: level, flags: top, used
dynamic    function            -                           literal argument
io         operation           literal mode string         literal argument
call       function            attribute or direct         receiver                      flags, of direct ones: imported
handler    exception type      -                           -                             flags: see HANDLER_FLAGS
function   name                module, method or local     signature                     value: depth, doc: first line, flags: top
class      name                -                           -                             names: attributes, flags: top
assign     target              -                           value                         names: literal strings in it
binding    signal              kind of handler             handler                       doc: signal expression
interface  module or name      import, public or private   -
=========  ==================  ==========================  ============================  ===================================

owner is the qualified name of what encloses the row, "<module>" at the top; class_name the class it counts to.
"""

from __future__ import annotations

import ast
import gc
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TEXT, _LONG, _LIST = pa.string(), pa.int64(), pa.list_(pa.string())
_COLUMNS = {
    "path": _TEXT, "kind": _TEXT, "name": _TEXT, "owner": _TEXT, "class_name": _TEXT, "lineno": _LONG, "end_lineno": _LONG,
    "value": _LONG, "mode": _TEXT, "detail": _TEXT, "doc": _TEXT, "names": _LIST, "flags": _LIST,
}
SCHEMA = ", ".join(f"{c} {'long' if t == _LONG else 'string' if t == _TEXT else 'array<string>'}" for c, t in _COLUMNS.items())
#: What the reports count.
BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)
DYNAMIC = ("import_module", "spec_from_file_location", "__import__", "find_spec")
DUNDERS = ("__init__", "__str__", "__repr__", "__len__", "__eq__", "__hash__", "__enter__", "__exit__", "__iter__", "__next__", "__getitem__", "__setitem__", "__delitem__", "__contains__")
WRITES = ("write_text", "write_bytes", "open", "dump", "dumps", "move", "copy", "copy2", "copytree", "rename", "replace", "unlink", "rmdir", "mkdir")
READS = ("read_text", "read_bytes", "load", "loads", "open", "glob", "rglob", "iterdir", "exists", "is_file", "is_dir", "stat")
LOGS = ("error", "warning", "exception", "critical", "debug", "info", "log")
HANDLER_FLAGS = ("is_broad", "has_pass", "silent_return", "has_log", "has_raise", "has_reraise")
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


#: What a kind needs of a tree: its top only, all statements, or expressions too. An error needs no more than the parse.
KINDS = {"interface": 1, "assign": 1, "import": 2, "handler": 2, "function": 2, "class": 2, "alias": 3, "dynamic": 3, "io": 3, "call": 3, "binding": 3, "error": 0}
_STATEMENTS, _LEAVES = ("cases", "finalbody", "orelse", "handlers", "body"), (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Constant, ast.alias)
#: Fields that hold no nodes, or only such as say nothing.
_PLAIN = frozenset(("ctx", "op", "ops", "id", "attr", "arg", "kind", "level", "module", "asname", "type_comment", "conversion", "simple", "is_async", "rest", "kwd_attrs"))
_CHILDREN = {c: () if issubclass(c, _LEAVES) else tuple(f for f in reversed(c._fields) if f not in _PLAIN) for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)}
_WITHIN = {c: tuple(f for f in _STATEMENTS if f in c._fields) if issubclass(c, (ast.stmt, ast.ExceptHandler, ast.match_case)) else () for c in _CHILDREN}
#: What the walk does at a node, beside going on below it.
_ROLES = dict.fromkeys(BLOCKS, "block") | dict.fromkeys(_DEFS, "def") | {ast.Call: "call", ast.ClassDef: "class", ast.Import: "import", ast.ImportFrom: "from", ast.ExceptHandler: "handler", ast.Assign: "assign"}
#: By what a kind needs: the fields that are gone into, and the nodes at which there is anything to do. An attribute says nothing but what it is of.
_DEPTHS = {n: (c, frozenset(t for t in c if (c[t] or t in _ROLES) and t is not ast.Attribute)) for n, c in ((1, dict.fromkeys(_CHILDREN, ())), (2, _WITHIN), (3, _CHILDREN))}
#: Kinds that only calls of certain names give.
_NAMED = {"dynamic": frozenset(DYNAMIC), "io": frozenset(WRITES + READS), "binding": frozenset(("connect",))}
_IO, _LETTERS = _NAMED["io"], frozenset("_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _plainly(node: ast.AST) -> str | None:
    """A name, dotted name, plain constant or list of such as text, as ast.unparse shows it; null for all else."""
    t = type(node)
    if t is ast.Name:
        return node.id
    if t is ast.Constant:
        return repr(node.value) if node.kind is None and type(node.value) in (str, int, bool, type(None)) else None
    if t is ast.List:
        items = [_plainly(x) for x in node.elts]
        return None if None in items else f"[{', '.join(items)}]"
    parts = []
    while type(node) is ast.Attribute:
        parts.append(node.attr)
        node = node.value
    return ".".join((node.id, *reversed(parts))) if type(node) is ast.Name else None


def _shown(node: ast.AST | None) -> str | None:
    try:
        return None if node is None else plain if (plain := _plainly(node)) is not None else ast.unparse(node)
    except RecursionError:
        return "..."


def _arguments(a: ast.arguments) -> str:
    """The arguments of a function, as ast.unparse shows them."""
    if a.posonlyargs or a.kwonlyargs or a.kwarg:
        return _shown(a)
    named = lambda x: x.arg if x.annotation is None else f"{x.arg}: {_shown(x.annotation)}"
    defaults = [None] * (len(a.args) - len(a.defaults)) + a.defaults
    shown = [named(x) if d is None else f"{named(x)}={_plainly(d)}" for x, d in zip(a.args, defaults, strict=True) if d is None or _plainly(d) is not None]
    if len(shown) < len(a.args) or a.vararg is not None and isinstance(a.vararg.annotation, ast.Starred):
        return _shown(a)
    return ", ".join(shown + ([f"*{named(a.vararg)}"] if a.vararg is not None else []))


def _literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _strings(node: ast.AST) -> list[str] | None:
    """The strings of a literal list, tuple, set or of the keys of a literal dict."""
    items = node.keys if isinstance(node, ast.Dict) else node.elts if isinstance(node, (ast.List, ast.Tuple, ast.Set)) else None
    return None if items is None else [x for x in map(_literal, items) if x is not None]


def _signature(f) -> str:
    returns = f" -> {_shown(f.returns)}" if f.returns is not None else ""
    return f"{'async ' * isinstance(f, ast.AsyncFunctionDef)}def {f.name}({_arguments(f.args)}){returns}"


def _doc(f) -> str | None:
    first = f.body[0]
    text = first.value.value if type(first) is ast.Expr and type(first.value) is ast.Constant else None
    text = text.expandtabs().strip() if isinstance(text, str) else ""
    return text.splitlines()[0].strip() if text else None


def _inside(body, fields=_CHILDREN) -> list[ast.AST]:
    """All nodes of some statements but names and constants, in no order; with _WITHIN for fields the statements only."""
    found, at = list(body), 0
    while at < len(found):
        node = found[at]
        at += 1
        for f in fields[type(node)]:
            v = getattr(node, f)
            for x in v if type(v) is list else (v,):
                if isinstance(x, ast.AST) and type(x) is not ast.Name and type(x) is not ast.Constant:
                    found.append(x)
    return found


def _handler(h: ast.ExceptHandler) -> tuple[str, list[str]]:
    """The handled type as text and the flags that hold."""
    wide = lambda t: isinstance(t, ast.Name) and t.id in ("Exception", "BaseException")
    kind = h.type
    if kind is None:
        name, broad = "bare", True
    elif isinstance(kind, ast.Tuple):
        name, broad = f"({', '.join(map(str, map(_shown, kind.elts)))})", any(map(wide, kind.elts))
    elif isinstance(kind, (ast.Name, ast.Attribute)):
        name, broad = _shown(kind), wide(kind) or getattr(kind, "attr", None) in ("Exception", "BaseException")
    else:
        name, broad = "unknown", False
    found = _inside(h.body)
    raised = [n.exc is None for n in found if isinstance(n, ast.Raise)]
    returned = [n.value for n in found if isinstance(n, ast.Return)]
    holds = (
        broad,
        any(isinstance(s, ast.Pass) for s in h.body),
        any(v is None or isinstance(v, ast.Constant) and (v.value is None or v.value in (0, "")) for v in returned),
        any(isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in LOGS for n in found),
        False in raised,
        True in raised,
    )
    return name, [f for f, yes in zip(HANDLER_FLAGS, holds, strict=True) if yes]


def _attributes(c: ast.ClassDef) -> list[str]:
    """Names assigned in the class body and self.x of __init__, sorted."""
    found = {t.id for s in c.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)}
    for s in c.body:
        if isinstance(s, _DEFS) and s.name == "__init__":
            single = (n.targets[0] for n in _inside([s], _WITHIN) if isinstance(n, ast.Assign) and len(n.targets) == 1)
            found |= {f"self.{t.attr}" for t in single if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"}
    return sorted(found)


def _bound(arg: ast.AST | None) -> tuple[str, str]:
    """A connected handler as text, and its kind."""
    if arg is None:
        return "<no argument>", "unresolved"
    if isinstance(arg, ast.Lambda):
        return f"lambda: {_shown(arg.body)}", "lambda"
    kinds = {ast.Attribute: "method", ast.Name: "local_func_or_dynamic", ast.Call: "call_expression"}
    return _shown(arg), kinds.get(type(arg), "unresolved")


def _of_call(c: ast.Call, kinds):
    """(kind, name, mode, detail, doc) of what a call says, as far as it is of these kinds."""
    f, first = c.func, c.args[0] if c.args else None
    direct = isinstance(f, ast.Name)
    name = f.id if direct else f.attr if isinstance(f, ast.Attribute) else None
    if name is None:
        return
    if "dynamic" in kinds and name in DYNAMIC:
        yield "dynamic", name, None, _literal(first), None
    if "io" in kinds and name in _IO:
        given = _literal(c.args[1]) if len(c.args) > 1 else None
        named = next((_literal(k.value) for k in c.keywords if k.arg == "mode"), None)
        yield "io", name, given if given is not None else named, _literal(first), None
    if "call" in kinds and name not in DUNDERS:
        on = None if direct else f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else None
        if direct or on is not None:
            yield "call", name, "direct" if direct else "attribute", on, None
    if not direct and name == "connect" and "binding" in kinds:
        shown, kind = _bound(first)
        yield "binding", f.value.attr if isinstance(f.value, ast.Attribute) else "<unknown>", kind, shown, _shown(f.value)


def facts(path: str, source: str | None, kinds=frozenset(KINDS)) -> list[dict]:
    """All facts of one source of the given kinds, in document order."""
    return [dict(zip(_COLUMNS, r, strict=True)) for r in _rows(path, source, kinds)]


def _rows(path: str, source: str | None, kinds) -> list:
    """The same as lists, a cell a column."""
    lines = _lines(source or "", kinds)
    if lines is not None and not lines:
        return []  # whether it parses or not
    try:
        return _facts(path, ast.parse(source or ""), kinds, lines)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [_row(path, "error", type(e).__name__, None, None, getattr(e, "lineno", None), None)] if "error" in kinds else []


def _lines(source: str, kinds) -> list[int] | None:
    """The lines outside of which there are no facts of these kinds, in order; null: there may be some in any line."""
    if not source.isascii() or not kinds <= _NAMED.keys():  # other letters may stand for plain ones in names
        return None
    if "\r" in source:
        source = source.replace("\r\n", "\n").replace("\r", "\n")
    places = set()
    for name in frozenset().union(*(_NAMED[k] for k in kinds)):
        at = source.find(name)
        while at >= 0:
            end = at + len(name)
            if source[end : end + 1] not in _LETTERS and (not at or source[at - 1] not in _LETTERS):
                places.add(at)
            at = source.find(name, end)
    lines, line, last = [], 1, 0
    for at in sorted(places):
        line, last = line + source.count("\n", last, at), at
        lines.append(line)
    return lines


def _row(path, kind, name, owner, class_name, lineno, end_lineno, value=None, mode=None, detail=None, doc=None, names=None, flags=None) -> list:
    return [path, kind, name, owner, class_name, lineno, end_lineno, value, mode, detail, doc, names, flags]


_VALUE, _FLAGS = list(_COLUMNS).index("value"), list(_COLUMNS).index("flags")


def _facts(path: str, tree: ast.Module, kinds, lines=None) -> list:
    out: list = []
    depth = max((KINDS[k] for k in kinds), default=0)
    if not depth:
        return out
    children, walked = _DEPTHS[depth]
    calls = not kinds.isdisjoint(("dynamic", "io", "call", "binding"))
    seen, used, local_names, aliases, direct = set(), set(), set(), [], []
    uses, attribute, name_ = used.add, ast.Attribute, ast.Name

    def put(kind, node, owner, name, class_name=None, **more):
        if kind in kinds:
            out.append(row := _row(path, kind, name, owner or "<module>", class_name, node.lineno, node.end_lineno, **more))
            return row

    def empty(node):
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
        at = bisect_left(lines, first)
        return at == len(lines) or lines[at] > node.end_lineno

    for top in tree.body:
        # where a node stands: qualified owner, class for functions, class for bindings, what it stands in, the function it counts to, blocks above it there
        place = ("", None, None, "module", None, 0)
        stack = [top]
        pop, push = stack.pop, stack.append
        while stack:
            node = pop()
            t = type(node)
            if t is tuple:  # back from below a node that is a place
                place = node
                continue
            if lines is not None and isinstance(node, ast.stmt) and empty(node):
                continue
            role = _ROLES.get(t)
            if role is not None:
                if role == "call":
                    if calls:
                        owner, _, bound_to, *_ = place
                        for kind, name, mode, detail, doc in _of_call(node, kinds):
                            if kind == "io":  # once a line
                                if (name, node.lineno) in seen:
                                    continue
                                seen.add((name, node.lineno))
                            row = put(kind, node, owner, name, bound_to if kind == "binding" else None, mode=mode, detail=detail, doc=doc)
                            if kind == "call" and mode == "direct" and row is not None:
                                direct.append((row, name))
                elif role == "block":
                    push(place)
                    owner, class_name, bound_to, inside, function, level = place
                    level += 1
                    place = owner, class_name, bound_to, inside, function, level
                    if function is not None:
                        function[_VALUE] = max(function[_VALUE], level)
                elif role == "def":
                    push(place)
                    owner, class_name, bound_to, inside, *_ = place
                    function = None
                    if "function" in kinds:
                        kind = {"class": "method", "def": "local", "module": "module"}[inside]
                        listed = ["top"] if node is top or inside == "class" and "." not in owner else []
                        function = put("function", node, owner, node.name, class_name, mode=kind, value=0, detail=_signature(node), doc=_doc(node), flags=listed)
                    place = f"{owner}.{node.name}".lstrip("."), None, bound_to, "def", function, 0
                elif role == "class":
                    push(place)
                    owner = place[0]
                    if "class" in kinds:
                        put("class", node, owner, node.name, names=_attributes(node), flags=["top"] if node is top else [])
                    place = f"{owner}.{node.name}".lstrip("."), node.name, node.name, "class", None, 0
                elif role == "import":
                    for a in node.names:
                        put("import", node, place[0], a.name, mode="import", detail=a.name.split(".")[0], names=[], value=0)
                elif role == "from":
                    if node.module:
                        put("import", node, place[0], node.module, mode="from", detail=node.module.split(".")[0], names=[a.name for a in node.names], value=node.level)
                        for a in node.names:
                            local = a.asname or a.name
                            local_names.add(local)
                            row = put("alias", node, place[0], local, mode=a.name, detail=node.module, value=node.level, flags=["top"] if node is top else [])
                            if row is not None:
                                aliases.append((row, local))
                elif role == "handler":
                    if "handler" in kinds:
                        name, flags = _handler(node)
                        put("handler", node, place[0], name, flags=flags)
                elif node is top and "assign" in kinds:
                    for target in node.targets:
                        if isinstance(target, ast.Name):
                            put("assign", node, place[0], target.id, detail=_shown(node.value), names=_strings(node.value))
                if node is top and "interface" in kinds:
                    if role == "import":
                        shown = [(a.name, "import") for a in node.names]
                    elif role == "from":
                        shown = [(f"{node.module or '.' * node.level} ({', '.join(a.name for a in node.names)})", "import")]
                    else:
                        shown = [(node.name, "private" if node.name.startswith("_") else "public")] if role in ("def", "class") else []
                    for name, mode in shown:
                        put("interface", node, place[0], name, mode=mode)
            for f in children[t]:
                v = getattr(node, f)
                for x in reversed(v) if type(v) is list else (v,):
                    c = type(x)
                    while c is attribute:
                        x = x.value
                        c = type(x)
                    if c is name_:
                        uses(x.id)
                    elif c in walked:
                        push(x)
    for row, name in aliases:
        row[_FLAGS] = row[_FLAGS] + ["used"] * (name in used)
    for row, name in direct:
        row[_FLAGS] = ["imported"] * (name in local_names)
    return out


def python_facts(files: DataFrame, *kinds: str) -> DataFrame:
    """files: path, text. All facts of each file, or those of the named kinds only, which cost less. Repeated files give repeated facts."""
    wanted = frozenset(kinds or KINDS)
    if not wanted <= KINDS.keys():
        raise ValueError(f"kinds are {', '.join(KINDS)}")

    def run(batches):
        gc.disable()  # trees hold no cycles
        for b in batches:
            for at in range(0, len(b), 100):
                part = b.slice(at, 100)
                rows = [r for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in _rows(p, t, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_COLUMNS), _COLUMNS.values(), strict=True)], list(_COLUMNS))
            gc.collect()

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def _has(flag: str):
    return F.array_contains("flags", flag)


def handlers(facts_: DataFrame) -> DataFrame:
    """Exception handlers with their flags and risk: path, lineno, function, exc_type, the flags, risk.

    A handler that raises is ok. Else one that passes or returns nothing of value is critical; one for all exceptions is
    silent if it logs and broad if not; any other is silent if it logs and ok if not.
    """
    rows = facts_.where("kind = 'handler'").select("path", "lineno", F.col("owner").alias("function"), F.col("name").alias("exc_type"), *(_has(f).alias(f) for f in HANDLER_FLAGS))
    raises = F.col("has_raise") | F.col("has_reraise")
    risk = F.when(raises, "ok").when(F.col("has_pass") | F.col("silent_return"), "critical").when(F.col("has_log"), "silent").when(F.col("is_broad"), "broad").otherwise("ok")
    return rows.withColumn("risk", risk)


def file_io(facts_: DataFrame) -> DataFrame:
    """File operations: path, lineno, function, op, io, arg; io is write, read or read/write. A mode string decides for open."""
    op, given = F.col("name"), F.col("mode")
    both = op.isin(*WRITES) & op.isin(*READS)
    by_mode = F.when(given.rlike("[wax]"), "write").when(given.contains("r"), "read").otherwise("read/write")
    io = F.when(op == "open", by_mode).when(both, "read/write").when(op.isin(*WRITES), "write").otherwise("read")
    return facts_.where("kind = 'io'").select("path", "lineno", F.col("owner").alias("function"), op.alias("op"), io.alias("io"), F.col("detail").alias("arg"))
