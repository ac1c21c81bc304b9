"""What grammars and the passes behind them reject and accept, by extension."""

import pytest

from gneiss.llm.syntax import invalid

# fmt: off
BAD = {'py':['1 = x','f() = 1','for 1 in x: pass','f(a=1, 2)','def f(x=1, y): pass','a, b += 1','del f()','with a as 1: pass','return 1','break','nonlocal x','def f(a,a): pass','def f(**k, a): pass','(a for a in b) = 1','x + 1 = 2','f(**k, *a)','lambda x=1, y: 0','class A:\n    return 1','while x:\n    def f():\n        break','f(a=1, a=2)','def f(*): pass','(a := 1) = 2','a.b := 1','yield 1','"a" = 1','None = 1','[a, 1] = x','a = 1 = b','x: int: 3','for x in y:\n    pass\nelse:\n    break'],
'js':['1 = x;','f() = 1;','const a;','let a; let a;','break;','return 1;','var x = 08;','delete x;','continue;','"a" = 1;','function f() { break; }'],
'java':['class A { void f() { 1 = x; } }','class A { void f() { g() = 1; } }','class A { void f() { 5; } }'],
'go':['package a\nfunc f() { 1 := 2 }\n','package a\nfunc f() { a.b := 2 }\n']}
OK = {'py':['a = b = c','a, *b = c','(a, b), c = d','a.b[c] = 1','f(x).y = 2','x[1:2] += 3','del a, b[0], (c, d)','for a.b, c in d: pass','with a as (b, c), d as e.f: pass','def f(a, b=1, /, c=2, *d, e, g=3, **h): pass','f(a, *b, c=1, *d, **e)','f(x for x in y)','lambda a, b=1, *c, d: 0','[x for x, *y in z]','x: int = 3','(x): int','a.b: int','print(x := 1)','while True:\n    if x: break\nelse:\n    pass','def f():\n    return\n    yield','async def f():\n    async for x in y:\n        continue','def f(): return 1','for x in y: continue','match = 1','f(match=1, case=2)','class A(B, metaclass=C): x = 1','def f():\n    x = 1\n    def g():\n        nonlocal x\n','x = lambda: (yield)','a[1], b = c','if x:\n    for y in z:\n        if q:\n            break','@a.b(c=1)\ndef f(): pass','del (a), [b]','f(a)(b)[c] = 1','x = yield_ = 1','def f(a, *, b): pass','def f(*, b, **k): pass','def f(a, /): pass','f(a, b,)','f(**k, a=1)','print(*a, sep="")','f(a=1)(a=2)','f(a=g(a=1), b=2)'],
'js':['a.b = 1; [c, d] = e; ({f} = g);','for (const x of y) { if (x) break; continue; }','function f() { return 1; }','const f = () => { return 1; };','class A { "x" = 1; 1 = 2; m() { return 1; } static { let a; } get y() { return 2; } }','switch (a) { case 1: break; }','let a; { let a; }','l: for (;;) { break l; }','const a = {return: 1, break: 2}; a.return; delete a.b;','for (let i = 0; i < 3; i++) {} for (let i = 0;;) break;','function f({a = 1} = {}, [b] = []) {}','if (f()) a = 1;','x = 0; y = 0.5; z = 0x10;','const {a, b} = c; const [d] = e;','while (x) break;','do { continue; } while (x)','f(function () { return 1; }); (function () { return 2; })();','a ||= b; a.b ??= c;','const o = { m() { return 1; }, async n() { return 2; } };'],
'ts':['enum A { B = 1, "C" = 2 }','declare const a: string;','function f(): number { return 1; }','function g(a: {b: string} = {b: "x"}): void { }','class A { readonly "x" = 1; f(): Map<string, number> { return 1 as any; } }','type T = { a: 1 };','const f = (a = 1): string => { return "a"; };','export const x = <T,>(a: T) => { return a; };'],
'java':['class A { int x = 1; @B(c = 1) void f() { x = 2; y[0] = 1; a.b().c = 3; this.x += 1; } }','class A { String f(int a) { return ""; } enum B { C(1) { }, D; } }','@A(b = {1, 2}) class C { }'],
'go':['package a\nfunc f() { a, b := g(); c[0] = 1; for i, x := range y { _ = x; _ = i } }\n']}
# fmt: on


@pytest.mark.parametrize(("extension", "text"), [(e, x) for e, xs in BAD.items() for x in xs])
def test_rejected(extension, text):
    valid, _, line, why = invalid.check(text, extension)
    assert not valid and line >= 1 and why


@pytest.mark.parametrize(("extension", "text"), [(e, x) for e, xs in OK.items() for x in xs])
def test_accepted(extension, text):
    assert invalid.check(text, extension)[0]


@pytest.mark.parametrize("text", [x for x in (*BAD["py"], *OK["py"])])
def test_as_the_interpreter(text):
    """The interpreter that runs the tests is of the version whose syntax counts."""
    try:
        compile(text, "x", "exec", dont_inherit=True)
        want = True
    except SyntaxError:
        want = False
    assert invalid.check(text, "py")[0] == want
