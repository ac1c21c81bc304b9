"""Grammars of the languages. They recognise; precedence is left out, and what a grammar of symbols can't say is in early.py."""

from __future__ import annotations

from functools import lru_cache

from gneiss.llm.syntax import lexers
from gneiss.llm.syntax.gll import Grammar

JSON = """
file = @relaxed { COMMENT } value { COMMENT } | @strict value ;
value = STRING | VALUE | '{' [ pairs ] '}' | '[' [ items ] ']' ;
pairs = note pair { ',' note pair } [ @relaxed ',' ] note ;
pair = STRING ':' note value note ;
items = note value note { ',' note value note } [ @relaxed ',' note ] ;
note = [ @relaxed COMMENT { COMMENT } ] ;
"""

PYTHON = """
file = { stmt } ;
stmt = line | compound ;
line = simple { ';' simple } [ ';' ] NEWLINE ;
simple = exprstmt | 'del' dels | 'pass' | 'break' | 'continue' | 'return' [ stars ] | 'raise' [ expr [ 'from' expr ] ]
  | 'global' name { ',' name } | 'nonlocal' name { ',' name } | 'assert' expr [ ',' expr ]
  | 'import' dotas { ',' dotas } | 'from' from | 'type' name [ tparams ] '=' expr ;
dotas = dotted [ 'as' name ] ;
dotted = name { '.' name } ;
from = ( dots [ dotted ] | dotted ) 'import' ( '*' | nameas { ',' nameas } | '(' nameas { ',' nameas } [ ',' ] ')' ) ;
dots = ( '.' | '...' ) { '.' | '...' } ;
nameas = name [ 'as' name ] ;
name = NAME | 'match' | 'case' | 'type' ;
exprstmt = rhs | single ( ':' expr [ '=' rhs ] | augop rhs ) | targets '=' { targets '=' } rhs ;
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
rhs = yield | stars ;
yield = 'yield' [ 'from' expr | stars ] ;
stars = star { ',' star } [ ',' ] ;
star = '*' flat | expr ;
named = expr | name ':=' expr ;
expr = 'lambda' [ lparams ] ':' expr | flat [ 'if' flat 'else' expr ] ;
flat = unary { op unary } ;
op = 'or' | 'and' | 'in' | 'not' 'in' | 'is' [ 'not' ] | '<' | '>' | '==' | '>=' | '<=' | '!=' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
unary = { 'not' | '-' | '+' | '~' | 'await' } primary ;
primary = atom { '(' [ args ] ')' | '[' subs ']' | '.' name } ;
atom = name | NUMBER | strings | '...' | 'None' | 'True' | 'False' | '(' [ yield | group ] ')' | '[' [ group ] ']' | '{' [ entries ] '}' ;
group = member [ comp | { ',' member } [ ',' ] ] ;
member = '*' flat | named ;
entries = entry [ comp | { ',' entry } [ ',' ] ] ;
entry = '**' flat | '*' flat | named [ ':' expr ] ;
comp = [ 'async' ] 'for' targets 'in' flat { 'if' compif | [ 'async' ] 'for' targets 'in' flat } ;
compif = 'lambda' [ lparams ] ':' expr | flat | name ':=' flat ;
targets = target { ',' target } [ ',' ] ;
target = [ '*' ] tatom ;
tatom = tprim | '(' [ targets ] ')' | '[' [ targets ] ']' ;
tprim = name | atom { '(' [ args ] ')' | '[' subs ']' | '.' name } ( '[' subs ']' | '.' name ) ;
single = tprim | '(' single ')' ;
dels = datom { ',' datom } [ ',' ] ;
datom = tprim | '(' [ dels ] ')' | '[' [ dels ] ']' ;
args = ( argp { ',' argp } [ ',' argk ] | argk ) [ ',' ] ;
argp = '*' expr | named [ comp ] ;
argk = name '=' expr { ',' ( name '=' expr | '*' expr ) } [ ',' argd ] | argd ;
argd = '**' expr { ',' ( '**' expr | name '=' expr ) } ;
subs = sub { ',' sub } [ ',' ] ;
sub = '*' flat | named [ ':' [ expr ] [ ':' [ expr ] ] ] | ':' [ expr ] [ ':' [ expr ] ] ;
strings = ( STRING | fstring ) { STRING | fstring } ;
fstring = 'FS' { field } 'FE' ;
field = 'F{' ( yield | stars ) [ 'F=' ] [ 'F!' name ] [ 'F:' { field } ] 'F}' ;
lparams = ( lhead [ ',' ltail ] | ltail ) [ ',' ] ;
lhead = name { ',' name } [ ',' '/' { ',' name } ] { ',' ldef } | { name ',' } ldef { ',' ldef } [ ',' '/' { ',' ldef } ] ;
ldef = name '=' expr ;
ltail = '*' name { ',' ( name | ldef ) } [ ',' lkw ] | '*' ',' ( name | ldef ) { ',' ( name | ldef ) } [ ',' lkw ] | lkw ;
lkw = '**' name ;
params = ( phead [ ',' ptail ] | ptail ) [ ',' ] ;
phead = plain { ',' plain } [ ',' '/' { ',' plain } ] { ',' pdef } | { plain ',' } pdef { ',' pdef } [ ',' '/' { ',' pdef } ] ;
plain = name [ ':' expr ] ;
pdef = name [ ':' expr ] '=' expr ;
ptail = '*' name [ ':' star ] { ',' ( plain | pdef ) } [ ',' pkw ] | '*' ',' ( plain | pdef ) { ',' ( plain | pdef ) } [ ',' pkw ] | pkw ;
pkw = '**' name [ ':' expr ] ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = [ '*' | '**' ] name [ ':' expr ] [ '=' star ] ;
block = line | NEWLINE INDENT stmt { stmt } DEDENT ;
compound = { '@' named NEWLINE } ( [ 'async' ] def | class ) | [ 'async' ] ( for | with ) | if | while | try | matchstmt ;
def = 'def' name [ tparams ] '(' [ params ] ')' [ '->' expr ] ':' block ;
class = 'class' name [ tparams ] [ '(' [ args ] ')' ] ':' block ;
if = 'if' named ':' block { 'elif' named ':' block } [ else ] ;
else = 'else' ':' block ;
while = 'while' named ':' block [ else ] ;
for = 'for' targets 'in' stars ':' block [ else ] ;
with = 'with' ( withitem { ',' withitem } | '(' withitem { ',' withitem } [ ',' ] ')' ) ':' block ;
withitem = expr [ 'as' tatom ] ;
try = 'try' ':' block ( except { except } [ else ] [ finally ] | finally ) ;
except = 'except' [ '*' ] [ expr [ 'as' name ] ] ':' block ;
finally = 'finally' ':' block ;
matchstmt = 'match' subject ':' NEWLINE INDENT case { case } DEDENT ;
subject = member { ',' member } [ ',' ] ;
case = 'case' patterns [ 'if' named ] ':' block ;
patterns = pattern { ',' pattern } [ ',' ] ;
pattern = '*' name | closed { '|' closed } [ 'as' name ] ;
closed = [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | strings | 'None' | 'True' | 'False' | dotted [ '(' [ pargs ] ')' ]
  | '(' [ patterns ] ')' | '[' [ patterns ] ']' | '{' [ pitem { ',' pitem } [ ',' ] ] '}' ;
pitem = '**' name | closed ':' pattern ;
pargs = parg { ',' parg } [ ',' ] ;
parg = pattern [ '=' pattern ] ;
"""

_NAMES = lambda words: " | ".join(f"'{w}'" for w in sorted(words))

JAVASCRIPT = f"""
file = {{ item }} ;
item = ( @module | @ts ) ( import | export ) | stmt ;
stmts = {{ stmt }} ;
eos = [ ';' ] ;
ident = NAME | {_NAMES(lexers.JS_SOFT)} | @sloppy ( 'let' | 'static' | 'yield' | 'await' | 'implements' | 'interface' | 'package' | 'private' | 'protected' | 'public' ) ;
anyname = NAME | {_NAMES(lexers.JS_SOFT | lexers.JS_WORDS)} ;
import = 'import' ( STRING [ attrs ] eos | [ @ts 'type' ] clause 'from' STRING [ attrs ] eos | @ts [ 'type' ] ident '=' expr eos ) ;
attrs = 'with' object ;
clause = ident [ ',' ( star | named ) ] | star | named ;
star = '*' 'as' ident ;
named = '{{' [ spec {{ ',' spec }} [ ',' ] ] '}}' ;
spec = [ @ts 'type' ] ( anyname | STRING ) [ 'as' ( anyname | STRING ) ] ;
export = 'export' ( 'default' ( function | class | @ts 'abstract' class | @ts interface | estmt eos ) | [ @ts 'type' ] ( '*' [ 'as' ( anyname | STRING ) ] 'from' STRING [ attrs ] eos | named [ 'from' STRING [ attrs ] ] eos )
  | var eos | function | class | tsdecl | @ts '=' expr eos | @ts 'as' 'namespace' ident eos | @ts 'import' ident '=' expr eos ) ;
stmt = block | var eos | ';' | if | for | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' [ ';' ] | 'continue' [ ident ] eos | 'break' [ ident ] eos
  | 'return' [ expr ] eos | 'throw' expr eos | try | switch | function | class | 'debugger' eos | estmt ( eos | ':' stmt ) | @sloppy 'with' '(' expr ')' stmt | tsdecl ;
block = '{{' stmts '}}' ;
estmt = expr ;
var = ( 'var' | 'let' | 'const' ) decl {{ ',' decl }} ;
decl = binding [ @ts '!' ] [ note ] [ '=' assign ] ;
note = @ts ':' type ;
if = 'if' '(' expr ')' stmt [ 'else' stmt ] ;
for = 'for' [ 'await' ] '(' ( [ var | expr ] ';' [ expr ] ';' [ expr ] | ( ( 'var' | 'let' | 'const' ) binding [ note ] | postfix ) ( 'of' assign | 'in' expr ) ) ')' stmt ;
try = 'try' block ( 'catch' [ '(' binding [ note ] ')' ] block [ 'finally' block ] | 'finally' block ) ;
switch = 'switch' '(' expr ')' '{{' {{ 'case' expr ':' stmts | 'default' ':' stmts }} '}}' ;
function = {{ decorator }} [ 'async' ] 'function' [ '*' ] [ ident ] [ tparams ] '(' [ params ] ')' [ ret ] ( block | @ts eos ) ;
ret = @ts ':' type ;
params = param {{ ',' param }} [ ',' ] ;
param = {{ decorator }} {{ @ts ( 'public' | 'private' | 'protected' | 'readonly' | 'override' ) }} [ '...' ] ( binding | @ts 'this' ) [ @ts '?' ] [ note ] [ '=' assign ] ;
binding = ident | '[' [ belem ] {{ ',' [ belem ] }} ']' | '{{' [ bprop {{ ',' bprop }} [ ',' ] ] '}}' ;
belem = [ '...' ] binding [ '=' assign ] ;
bprop = '...' ident | key ':' belem | ident [ '=' assign ] ;
key = anyname | STRING | NUMBER | '[' assign ']' | PRIVATE ;
class = {{ decorator }} [ @ts 'abstract' ] 'class' [ ident ] [ tparams ] [ 'extends' postfix [ targs ] ] [ @ts 'implements' type {{ ',' type }} ] '{{' {{ ';' | member }} '}}' ;
decorator = '@' ( ident | '(' expr ')' ) {{ '.' anyname | '(' [ args ] ')' }} ;
member = {{ decorator }} ( 'static' block | {{ modifier }} ( method | fieldm | @ts index ) ) ;
modifier = 'static' | 'async' | 'accessor' | @ts ( 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' ) ;
method = [ 'get' | 'set' ] [ '*' ] key [ @ts '?' ] [ tparams ] '(' [ params ] ')' [ ret ] ( block | @ts eos ) ;
fieldm = key [ @ts ( '?' | '!' ) ] [ note ] [ '=' assign ] eos ;
index = '[' ident ':' type ']' note eos ;
expr = assign {{ ',' assign }} ;
assign = arrow | 'yield' [ [ '*' ] assign ] | flat ;
arrow = ( 'async' ident | [ 'async' ] [ tparams ] '(' [ params ] ')' [ ret ] ) !'=>' ( block | assign ) ;
flat = unary {{ op unary | aop ( arrow | 'yield' [ [ '*' ] assign ] | unary ) | '?' assign ':' assign | @ts ( 'as' | 'satisfies' ) type }} ;
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' [ '>' ] '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
op = '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '===' | '!=='
  | '<' | '<=' | '>=' | '>' [ '>' [ '>' ] ] | 'instanceof' | 'in' | '<<' | '+' | '-' | '*' | '/' | '%' | '**' ;
unary = {{ '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' | 'new' | @ts '<' type '>' }} postfix ;
postfix = primary {{ '.' ( anyname | PRIVATE ) | '?.' ( anyname | PRIVATE | '(' [ args ] ')' | '[' expr ']' ) | '[' expr ']' | '(' [ args ] ')' | template | !'++' | !'--' | @ts !'!' | @ts targs ( '(' [ args ] ')' | template ) }} ;
primary = ident [ !'=>' ( block | assign ) ] | 'this' | 'super' | NUMBER | STRING | REGEX | 'null' | 'true' | 'false' | template | '(' expr ')' | '[' [ aelem ] {{ ',' [ aelem ] }} ']' | object | function | class | PRIVATE
  | 'import' ( '(' assign [ ',' [ assign [ ',' ] ] ] ')' | '.' 'meta' ) | 'new' '.' 'target' ;
aelem = [ '...' ] assign ;
args = aelem {{ ',' aelem }} [ ',' ] ;
template = TPL | THEAD expr {{ TMID expr }} TTAIL ;
object = '{{' [ prop {{ ',' prop }} [ ',' ] ] '}}' ;
prop = '...' assign | key ':' assign | ident [ '=' assign ] | [ 'async' ] [ '*' ] [ 'get' | 'set' ] key [ tparams ] '(' [ params ] ')' [ ret ] block ;
tparams = @ts '<' tparam {{ ',' tparam }} [ ',' ] '>' ;
tparam = {{ 'const' | 'in' | 'out' }} ident [ 'extends' type ] [ '=' type ] ;
targs = @ts '<' type {{ ',' type }} '>' ;
type = {{ 'asserts' }} ( ident | 'this' ) 'is' type | union [ 'extends' type '?' type ':' type ] | [ 'abstract' ] [ 'new' ] [ tparams ] '(' [ params ] ')' '=>' type ;
union = [ '|' | '&' ] part {{ ( '|' | '&' ) part }} ;
part = {{ 'keyof' | 'readonly' | 'unique' | 'infer' | 'asserts' }} tatom {{ !'[' [ type ] ']' }} ;
tatom = '(' type ')' | STRING | NUMBER | '-' NUMBER | 'true' | 'false' | 'null' | 'void' | 'this' | TPL | THEAD type {{ TMID type }} TTAIL | qname [ targs ] | 'typeof' ( qname | 'this' | 'import' '(' STRING ')' ) {{ '.' anyname }} [ targs ]
  | 'import' '(' STRING ')' {{ '.' anyname }} [ targs ] | '{{' [ mapped | {{ tmember }} ] '}}' | '[' [ telem {{ ',' telem }} [ ',' ] ] ']' ;
qname = ident {{ '.' anyname }} ;
telem = [ '...' ] ( type [ '?' ] | anyname [ '?' ] ':' type ) ;
mapped = [ [ '+' | '-' ] 'readonly' ] '[' ident 'in' type [ 'as' type ] ']' [ [ '+' | '-' ] '?' ] [ ':' type ] [ ';' | ',' ] ;
tmember = ( {{ 'readonly' }} ( '[' ident ':' type ']' ':' type | key [ '?' ] [ ':' type ] ) | [ 'get' | 'set' ] [ 'new' ] [ key ] [ '?' ] [ tparams ] '(' [ params ] ')' [ ':' type ] ) ( ',' | eos ) ;
interface = 'interface' ident [ tparams ] [ 'extends' type {{ ',' type }} ] '{{' {{ tmember }} '}}' ;
tsdecl = @ts ( interface | 'type' ident [ tparams ] '=' type eos | [ 'const' ] 'enum' ident '{{' [ enumm {{ ',' enumm }} [ ',' ] ] '}}'
  | ( 'namespace' | 'module' ) ( qname | STRING ) ( '{{' {{ item }} '}}' | eos ) | 'declare' ( var eos | function | class | tsdecl | 'global' '{{' {{ item }} '}}' ) | 'abstract' class ) ;
enumm = key [ '=' assign ] ;
"""

GO = """
file = 'package' NAME ';' { import ';' } [ top ] { ';' [ top ] } ;
import = 'import' ( ispec | '(' [ ispec ] { ';' [ ispec ] } ')' ) ;
ispec = [ NAME | '.' ] STRING ;
top = decl | 'func' [ params ] NAME [ tparams ] sig [ block ] ;
decl = 'var' ( vspec | '(' [ vspec ] { ';' [ vspec ] } ')' ) | 'const' ( cspec | '(' [ cspec ] { ';' [ cspec ] } ')' ) | 'type' ( tspec | '(' [ tspec ] { ';' [ tspec ] } ')' ) ;
vspec = names ( type [ '=' exprs ] | '=' exprs ) ;
cspec = names [ [ type ] '=' exprs ] ;
tspec = NAME [ tparams ] [ '=' ] type ;
names = NAME { ',' NAME } ;
tparams = '[' tpar { ',' tpar } [ ',' ] ']' ;
tpar = names constraint ;
constraint = [ '~' ] type { '|' [ '~' ] type } ;
sig = params [ params | type ] ;
params = '(' [ param { ',' param } [ ',' ] ] ')' ;
param = NAME [ '...' ] type | [ '...' ] type ;
type = NAME [ '.' NAME ] [ targs ] | '*' type | '(' type ')' | typelit ;
targs = '[' type { ',' type } [ ',' ] ']' ;
typelit = '[' [ '...' | expr ] ']' type | 'map' '[' type ']' type | 'chan' [ '<-' ] type | '<-' 'chan' type | 'func' sig | 'struct' '{' [ field ] { ';' [ field ] } '}' | 'interface' '{' [ elem ] { ';' [ elem ] } '}' ;
field = ( names type | [ '*' ] NAME [ '.' NAME ] [ targs ] ) [ STRING ] ;
elem = NAME sig | constraint ;
block = '{' stmts '}' ;
stmts = [ stmt ] { ';' [ stmt ] } ;
stmt = decl | simple | NAME ':' [ stmt ] | 'go' expr | 'defer' expr | 'return' [ exprs ] | 'break' [ NAME ] | 'continue' [ NAME ] | 'goto' NAME | 'fallthrough' | block | if | switch | select | for ;
simple = exprs [ ':=' exprs | assignop exprs | '++' | '--' | '<-' expr ] ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
if = 'if' [ [ simple ] ';' ] expr block [ 'else' ( if | block ) ] ;
switch = 'switch' [ [ simple ] ';' ] [ simple ] '{' { ( 'case' cases | 'default' ) ':' stmts } '}' ;
cases = ( expr | typelit ) { ',' ( expr | typelit ) } ;
select = 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}' ;
for = 'for' [ expr | [ simple ] ';' [ expr ] ';' [ simple ] | [ exprs ( ':=' | '=' ) ] 'range' expr ] block ;
exprs = expr { ',' expr } ;
expr = unary { op unary } ;
op = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
unary = { '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~' } primary ;
primary = operand { '.' ( NAME | '(' ( type | 'type' ) ')' ) | index | '(' [ arg { ',' arg } [ '...' ] [ ',' ] ] ')' | lit } ;
arg = expr | typelit ;
index = '[' ( iexpr { ',' iexpr } [ ',' ] | [ expr ] ':' [ expr ] [ ':' expr ] ) ']' ;
iexpr = expr | typelit ;
operand = NUMBER | STRING | RUNE | NAME | '(' ( expr | type ) ')' | 'func' sig block | typelit ;
lit = '{' [ elt { ',' elt } [ ',' ] ] '}' ;
elt = ( expr | lit ) [ ':' ( expr | lit ) ] ;
"""

JAVA = f"""
file = [ mods 'package' qname ';' ] {{ 'import' [ 'static' ] qname [ '.' '*' ] ';' | ';' }} {{ typedecl | ';' }} | mods [ 'open' ] 'module' qname '{{' {{ directive }} '}}' ;
directive = ( 'requires' {{ 'transitive' | 'static' }} qname | ( 'exports' | 'opens' ) qname [ 'to' qname {{ ',' qname }} ] | 'uses' qname | 'provides' qname 'with' qname {{ ',' qname }} ) ';' ;
ident = NAME | {_NAMES(lexers.JAVA_SOFT)} ;
qname = ident {{ '.' ident }} ;
mods = {{ mod }} ;
mod = annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
annotation = '@' qname [ '(' [ apair {{ ',' apair }} | aval ] ')' ] ;
apair = ident '=' aval ;
aval = expr | annotation | '{{' [ aval {{ ',' aval }} ] [ ',' ] '}}' ;
typedecl = mods ( class | interface | enum | record | atype ) ;
class = 'class' ident [ tparams ] [ 'extends' type ] [ 'implements' types ] [ 'permits' types ] body ;
interface = 'interface' ident [ tparams ] [ 'extends' types ] [ 'permits' types ] body ;
atype = '@' 'interface' ident body ;
record = 'record' ident [ tparams ] '(' [ params ] ')' [ 'implements' types ] body ;
enum = 'enum' ident [ 'implements' types ] '{{' [ const {{ ',' const }} ] [ ',' ] [ ';' {{ member }} ] '}}' ;
const = {{ annotation }} ident [ '(' [ args ] ')' ] [ body ] ;
body = '{{' {{ member }} '}}' ;
member = ';' | [ 'static' ] block | mods ( class | interface | enum | record | atype | [ tparams ] method | [ tparams ] constructor | type declarators ';' ) ;
method = ( type | 'void' ) ident '(' [ params ] ')' {{ dim }} [ 'throws' types ] ( block | [ 'default' aval ] ';' ) ;
constructor = ident ( '(' [ params ] ')' [ 'throws' types ] block | block ) ;
params = param {{ ',' param }} ;
param = {{ 'final' | annotation }} type {{ annotation }} [ '...' ] ( ident | [ ident '.' ] 'this' ) {{ dim }} ;
declarators = declarator {{ ',' declarator }} ;
declarator = ident {{ dim }} [ '=' init ] ;
init = expr | '{{' [ init {{ ',' init }} ] [ ',' ] '}}' ;
dim = {{ annotation }} '[' ']' ;
types = type {{ ',' type }} ;
type = {{ annotation }} ( prim | ident [ targs ] {{ '.' {{ annotation }} ident [ targs ] }} ) {{ dim }} ;
prim = 'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' ;
targs = '<' [ targ {{ ',' targ }} ] '>' ;
targ = type | {{ annotation }} '?' [ ( 'extends' | 'super' ) type ] ;
tparams = '<' tparam {{ ',' tparam }} '>' ;
tparam = {{ annotation }} ident [ 'extends' type {{ '&' type }} ] ;
block = '{{' {{ stmt }} '}}' ;
local = {{ 'final' | annotation }} type declarators ;
stmt = block | ';' | local ';' | typedecl | 'if' par stmt [ 'else' stmt ] | 'while' par stmt | 'do' stmt 'while' par ';' | for | switch | try | 'synchronized' par block | 'throw' expr ';' | 'return' [ expr ] ';'
  | 'break' [ ident ] ';' | 'continue' [ ident ] ';' | 'yield' expr ';' | 'assert' expr [ ':' expr ] ';' | ident ':' stmt | expr ';' ;
par = '(' expr ')' ;
for = 'for' '(' ( [ local | expr {{ ',' expr }} ] ';' [ expr ] ';' [ expr {{ ',' expr }} ] | {{ 'final' | annotation }} type ident {{ dim }} ':' expr ) ')' stmt ;
switch = 'switch' par '{{' {{ label }} '}}' ;
label = ( 'case' clabel {{ ',' clabel }} [ 'when' expr ] | 'default' ) ( ':' {{ stmt }} | '->' ( expr ';' | block | 'throw' expr ';' ) ) ;
clabel = expr | pattern | 'default' ;
pattern = {{ 'final' | annotation }} type ( ident | '(' [ pattern {{ ',' pattern }} ] ')' [ ident ] ) ;
try = 'try' ( '(' resource {{ ';' resource }} [ ';' ] ')' block {{ catch }} [ 'finally' block ] | block ( catch {{ catch }} [ 'finally' block ] | 'finally' block ) ) ;
resource = {{ 'final' | annotation }} type ident '=' expr | expr ;
catch = 'catch' '(' {{ 'final' | annotation }} type {{ '|' type }} ident ')' block ;
expr = lambda | unary {{ op unary | 'instanceof' ( type | pattern ) | '?' expr ':' ( lambda | unary ) }} [ op lambda ] ;
lambda = ( ident | '(' [ lparam {{ ',' lparam }} ] ')' ) '->' ( expr | block ) ;
lparam = ident | param ;
op = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '<=' | '>=' | '>' [ '>' [ '>' ] [ '>=' ] | '>=' ] | '<<' | '+' | '-' | '*' | '/' | '%' ;
unary = {{ '+' | '-' | '!' | '~' | '++' | '--' | '(' type {{ '&' type }} ')' }} ( primary | castlambda ) ;
castlambda = '(' type {{ '&' type }} ')' lambda ;
primary = first {{ '.' ( [ targs ] ident | 'this' | 'class' | 'super' | 'new' creator ) | '(' [ args ] ')' | '[' expr ']' | '++' | '--' | '::' [ targs ] ( ident | 'new' ) | targs '::' ( ident | 'new' ) | dim {{ dim }} ( '::' 'new' | '.' 'class' ) }} ;
first = NUMBER | STRING | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | ident | '(' expr ')' | 'new' creator | switch | ( prim | 'void' ) {{ dim }} ( '.' 'class' | '::' 'new' ) ;
creator = {{ annotation }} ( prim | ident [ targs ] {{ '.' {{ annotation }} ident [ targs ] }} ) ( '(' [ args ] ')' [ body ] | dim {{ dim }} ainit | '[' expr ']' {{ '[' expr ']' }} {{ dim }} ) | targs creator ;
ainit = '{{' [ init {{ ',' init }} ] [ ',' ] '}}' ;
args = expr {{ ',' expr }} ;
"""

#: The lexer, grammar and dialects of each language; the first dialect is the strict one.
LANGUAGES = {
    "python": (lexers.python, PYTHON, ("python3",), {"inline": ("name", "op", "augop", "unary", "primary", "atom", "star", "rhs", "named", "member", "dots", "nameas", "dotted", "dotas", "entry", "strings", "sub", "withitem", "simple", "tparam", "closed", "target", "datom", "argp", "ldef", "lkw", "plain", "pdef", "pkw")}),
    "javascript": (lexers.javascript, JAVASCRIPT, ("module", "ts", "sloppy"), {"breaks": True, "eos": "eos", "barred": {"estmt": {"{", "function", "class"}}, "inline": ("ident", "anyname", "op", "aop", "unary", "primary", "spec", "modifier", "aelem", "note", "ret", "belem", "key", "decl", "var", "method", "fieldm", "index", "member", "prop")}),
    "go": (lexers.go, GO, ("go",), {"inline": ("op", "assignop", "unary", "operand", "iexpr", "arg", "names", "ispec", "field", "elem", "tpar", "param")}),
    "java": (lexers.java, JAVA, ("java",), {"inline": ("ident", "op", "prim", "first", "mod", "qname", "lparam", "apair", "par", "declarator", "targ", "tparam")}),
    "json": (lexers.json, JSON, ("strict", "relaxed"), {}),
}


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """Built once per worker process."""
    _, text, dialects, options = LANGUAGES[language]
    return Grammar(text, "file", dialects, **options)
