"""Token patterns and grammars of the languages that are checked.

The grammars follow the published syntax of each language closely enough that what they reject is wrong or rare;
where an exact parser is at hand, rejected files are put to it (see syntax.py). Precedence of operators is left
out: it does not decide whether a text is valid.
"""

from __future__ import annotations

# JavaScript and TypeScript. T{...} stands in TypeScript only, X{...} where JSX is allowed.

_SCRIPT = """
program = items ;
items = (sc | so eos | module)* so? ;
stmts = (sc | so eos)* so? ;
eos = ';' | 'nl' ;
module = import eos | import | export eos | export ;
import = 'import' T{'type'?} (str | clause 'from' str) (('with' | 'assert') object)? T{| 'import' ident '=' assign} ;
clause = ident (',' (ns | named))? | ns | named ;
ns = '*' 'as' ident ;
named = '{' (spec (',' spec)* ','?)? '}' ;
spec = T{'type'?} name ('as' name)? | str 'as' name ;
export = 'export' (sc | vardecl T{| typealias | 'as' 'namespace' ident | '=' assign | 'type' named ('from' str)?}
  | 'default' (function | class | assign T{| interface}) | named ('from' str)? | '*' ('as' name)? 'from' str) ;
sc = block | ';' | if | for | while | 'with' '(' expr ')' sub | function | class | try | switch | label sub T{| interface | enum | namespace | declare} ;
so = vardecl | 'return' expr? | 'throw' expr | ('break' | 'continue') ident? | 'debugger' | expr | 'do' sub 'while' '(' expr ')'
  | 'if' '(' expr ')' (sub 'else')? so | 'for' 'await'? '(' forhead ')' so | 'while' '(' expr ')' so | label so
  T{| typealias | 'declare' (vardecl | typealias | 'function' ident sig) | 'function' ident sig | 'abstract' member} ;
label = ident ':' ;
sub = sc | so eos ;
block = '{' stmts '}' ;
if = 'if' '(' expr ')' sub ('else' sub)? ;
while = 'while' '(' expr ')' sub ;
for = 'for' 'await'? '(' forhead ')' sub ;
forhead = (vardecl | vars | expr)? ';' expr? ';' expr? | (('const' | 'let' | 'var') binding | operand) ('of' | 'in') expr ;
vars = ('let' | 'var') vd (',' vd)* ;
try = 'try' block ('catch' ('(' binding T{typeann?} ')')? block ('finally' block)? | 'finally' block) ;
switch = 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmts)* '}' ;
vardecl = 'const' vi (',' vi)* | ('let' | 'var') vd (',' vd)* ;
vi = binding T{'!'? typeann?} '=' assign T{| binding typeann} ;
vd = binding T{'!'? typeann?} ('=' assign)? ;
binding = ident | '{' (bp (',' bp)* ','?)? '}' | '[' ','* (be (','+ be)* ','*)? ']' ;
bp = '...' binding | ident ('=' assign)? | key ':' binding ('=' assign)? ;
be = '...' binding | binding ('=' assign)? ;
function = 'async'? 'function' '*'? ident? sig block ;
sig = T{tparams?} '(' params ')' T{rett?} ;
params = (param (',' param)* ','?)? ;
param = deco* T{mod*} ('...' binding | binding) T{'?'? typeann?} ('=' assign)? T{| 'this' typeann} ;
class = deco* T{'abstract'?} 'class' ident? T{tparams?} ('extends' operand T{targs?})? T{('implements' type (',' type)*)?} '{' (mc | mo eos)* mo? '}' ;
mc = ';' | deco* mod* ('get' | 'set')? '*'? key T{'?'?} sig block | 'static' block ;
mo = member ;
member = deco* mod* key T{('?' | '!')? typeann?} ('=' assign)? T{| deco* mod* ('get' | 'set')? key '?'? sig | mod* '[' ident ':' type ']' typeann} ;
mod = 'static' | 'async' T{| 'mod' | 'abstract' | 'declare' | 'readonly'} | 'accessor' ;
deco = '@' ident ('.' name)* ('(' args ')')? | '@' '(' expr ')' ;
key = name | str | 'num' | '[' assign ']' | 'private' ;
name = ident | word ;
ident = 'id' | 'async' | 'get' | 'set' | 'of' | 'from' | 'as' | 'type' | 'declare' | 'namespace' | 'abstract' | 'is' | 'readonly' | 'infer' | 'keyof'
  | 'mod' | 'accessor' | 'interface' | 'static' | 'assert' | 'satisfies' | 'asserts' | 'unique' | 'implements' | 'let' ;
word = 'import' | 'export' | 'default' | 'return' | 'throw' | 'break' | 'continue' | 'debugger' | 'do' | 'while' | 'if' | 'else' | 'for' | 'await' | 'with'
  | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'const' | 'var' | 'function' | 'class' | 'extends' | 'in' | 'instanceof' | 'typeof' | 'void'
  | 'delete' | 'new' | 'yield' | 'this' | 'super' | 'null' | 'true' | 'false' | 'enum' ;
expr = assign (',' assign)* ;
assign = 'yield' ('*'? assign)? | arrow | operand (bin (operand | arrow | 'yield' assign))* ('?' assign ':' assign)? ;
bin = 'bin' | '+' | '-' | '*' | '/' | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '|' | '=' | 'in' | 'instanceof' | 'asg' | '>' '>' 'geq' | '>' 'geq' | 'geq' ;
operand = pre* post ;
pre = '!' | '~' | '+' | '-' | 'inc' | 'typeof' | 'void' | 'delete' | 'await' | 'new' T{| '<' type '>'} ;
post = primary tail* 'inc'? ;
tail = '.' (name | 'private') | 'opt' (name | '[' expr ']' | '(' args ')' | 'private') | '[' expr ']' | T{targs?} '(' args ')' | 'tpl' T{| '!' | ('as' | 'satisfies') type | targs} ;
primary = ident | 'num' | str | 'tpl' | 'regex' | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | array | object | function | class
  | 'import' ('(' args ')' | '.' name) | 'new' '.' name | 'private' 'in' operand X{| jsx} ;
array = '[' ','* (sp (','+ sp)* ','*)? ']' ;
object = '{' (prop (',' prop)* ','?)? '}' ;
prop = '...' assign | ident ('=' assign)? | key ':' assign | ('async' | 'get' | 'set')? '*'? key sig block ;
arrow = 'async'? (ident | sig) 'arrow' (block | assign) T{| 'async'? tparams '(' params ')' rett? 'arrow' (block | assign)} ;
args = (sp (',' sp)* ','?)? ;
sp = '...'? assign ;
str = 'str' ;
"""
_TYPES = """
typealias = 'type' ident tparams? '=' type ;
interface = 'interface' ident tparams? ('extends' type (',' type)*)? '{' tms '}' ;
enum = 'const'? 'enum' ident '{' (em (',' em)* ','?)? '}' ;
em = (name | str) ('=' assign)? ;
namespace = ('namespace' | 'mod') (str | ident ('.' name)*) '{' items '}' ;
declare = 'declare' (namespace | class | enum | interface | 'id' '{' items '}') ;
typeann = ':' type ;
rett = ':' (type | 'asserts'? (ident | 'this') ('is' type)?) ;
type = ('|' | '&')? tu (('|' | '&') tu)* ('extends' type '?' type ':' type)? | ident 'is' type ;
tu = ('keyof' | 'typeof' | 'readonly' | 'unique' | 'infer' | 'new' | 'abstract')* tp ('[' type? ']')* ;
tp = ident ('.' name)* targs? | str | 'num' | '-' 'num' | 'tpl' | 'null' | 'true' | 'false' | 'void' | 'this' | '{' tms '}' | '[' (te (',' te)* ','?)? ']'
  | '(' type ')' | tparams? '(' params ')' 'arrow' rtype | 'import' '(' str ')' ('.' name)* targs? ;
rtype = type | 'asserts'? (ident | 'this') ('is' type)? ;
te = '...'? (ident '?'? ':')? type '?'? ;
targs = '<' type (',' type)* ','? '>' ;
tparams = '<' tpar (',' tpar)* ','? '>' ;
tpar = ('const' | 'in')* ident ('extends' type)? ('=' type)? ;
tms = (tm (';' | ',' | 'nl'))* tm? ;
tm = mod* ('get' | 'set')? key '?'? (tparams? '(' params ')' rett? | typeann?) | 'new'? tparams? '(' params ')' rett?
  | ('-' | '+')? 'readonly'? '[' ident (':' type | 'in' type ('as' type)?) ']' (('-' | '+')? '?')? typeann? ;
"""
_JSX = """
jsx = '<' jname jattr* ('/' '>' | '>' jchild* '<' '/' jname '>') | '<' '>' jchild* '<' '/' '>' ;
jname = name (('-' | ':') name)* ('.' name)* T{targs?} ;
jattr = name (('-' | ':') (name | 'num'))* ('=' (str | '{' expr '}' | jsx))? | '{' '...' assign '}' ;
jchild = '{' ('...'? expr)? '}' | jsx | jtext ;
jtext = name | 'num' | str | 'tpl' | '.' | ',' | ';' | ':' | '?' | '!' | '(' | ')' | '[' | ']' | '+' | '-' | '*' | '/' | '=' | '&' | '|' | 'bin' | 'odd' | '...' | '@' | '~' | 'opt' | 'inc' | 'private' | 'arrow' | 'asg' ;
"""


def script(types: bool, jsx: bool) -> str:
    """The grammar of JavaScript, with TypeScript's and JSX's additions as asked."""
    import re

    text = _SCRIPT + (_TYPES if types else "") + (_JSX if jsx else "")
    for mark, on in (("T", types), ("X", jsx)):
        while (m := re.search(mark + r"\{((?:[^{}']|'[^']*')*)\}", text)) is not None:
            text = text[: m.start()] + (m[1] if on else "") + text[m.end() :]
    return text


GO = """
file = 'package' 'id' ';' ('import' (imp | '(' (imp ';')* imp? ')') ';')* (decl ';')* decl? ;
imp = ('id' | '.')? 'str' ;
decl = func | var | typedecl ;
var = ('var' | 'const') (vs | '(' (vs ';')* vs? ')') ;
vs = 'id' (',' 'id')* type? ('=' exprs)? ;
typedecl = 'type' (ts | '(' (ts ';')* ts? ')') ;
ts = 'id' tparams? '='? type ;
tparams = '[' tpar (',' tpar)* ','? ']' ;
tpar = 'id' (',' 'id')* cons ;
cons = 'tilde'? type ('bar' 'tilde'? type)* ;
func = 'func' (params)? 'id' tparams? sig block? ;
sig = params (params | type)? ;
params = '(' (pd (',' pd)* ','?)? ')' ;
pd = '...'? type | 'id' '...'? type ;
type = 'id' ('.' 'id')? targs? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'arrow'? 'chan' 'arrow'? type | 'func' sig | struct | iface | '(' type ')' ;
targs = '[' type (',' type)* ','? ']' ;
struct = 'struct' '{' (fd ';')* fd? '}' ;
fd = ('id' (',' 'id')* type | '*'? 'id' ('.' 'id')? targs?) 'str'? ;
iface = 'interface' '{' ((('id' sig) | cons) ';')* (('id' sig) | cons)? '}' ;
block = '{' stmts '}' ;
stmts = (stmt? ';')* stmt? ;
stmt = simple | var | typedecl | 'return' exprs? | ('break' | 'continue' | 'goto') 'id'? | 'fallthrough' | block | if | switch | select | for | ('go' | 'defer') expr | 'id' ':' stmt? ;
simple = exprs (('=' | 'define' | 'asg') exprs | 'inc' | 'arrow' expr)? ;
if = 'if' (simple? ';')? expr block ('else' (if | block))? ;
for = 'for' (simple? ';' expr? ';' simple? | expr | (exprs ('=' | 'define'))? 'range' expr)? block ;
switch = 'switch' (simple? ';')? simple? '{' (('case' exprs | 'default') ':' stmts)* '}' ;
select = 'select' '{' (('case' simple | 'default') ':' stmts)* '}' ;
exprs = expr (',' expr)* ;
expr = unary (('bin' | '+' | '-' | '*' | '&' | 'bar' | '^') unary)* ;
unary = ('+' | '-' | '!' | '^' | '*' | '&' | 'arrow' | 'tilde')* post ;
post = prim tail* ;
tail = '.' ('id' | '(' (type | 'type') ')') | '[' (expr? ':' expr? (':' expr)? | type (',' type)* ','? | expr) ']' | '(' args ')' | lit ;
prim = 'id' | 'num' | 'str' | '(' (expr | type) ')' | 'func' sig block? | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | struct | iface | 'arrow'? 'chan' type ;
lit = '{' (el (',' el)* ','?)? '}' ;
el = (val ':')? val ;
val = expr | lit ;
args = ((expr | type) (',' (expr | type))* '...'? ','?)? ;
"""

RUST = """
file = 'shebang'? inner* item* ;
inner = '#' '!' '[' tt* ']' ;
attr = '#' '[' tt* ']' ;
item = attr* vis? kind ;
vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')? ;
kind = 'use' use ';' | fn | struct | enum | impl | trait | mod | const | 'type' id gen? (':' bounds)? where? ('=' type)? where? ';' | 'extern' 'crate' id ('as' id)? ';'
  | 'unsafe'? 'extern' 'str'? '{' item* '}' | macro | 'union' id gen? '{' fields '}' ;
macro = path '!' id? ('{' tt* '}' | ('(' tt* ')' | '[' tt* ']') ';') ;
use = ('::'? useseg '::')? ('*' | '{' (use (',' use)* ','?)? '}') | '::'? useseg ('as' (id | '_'))? ;
useseg = pid ('::' pid)* ;
pid = id | 'crate' | 'self' | 'super' ;
id = 'id' | 'union' | 'auto' ;
fn = ('const' | 'async' | 'unsafe' | 'extern' 'str'?)* 'fn' id gen? '(' fps ')' ('->' type)? where? (block | ';') ;
fps = (fp (',' fp)* ','?)? ;
fp = attr* ('&' 'life'? 'mut'? 'self' | 'mut'? 'self' (':' type)? | pat ':' type | '...') ;
struct = 'struct' id gen? where? ('{' fields '}' | '(' tfields ')' where? ';' | ';') ;
fields = (field (',' field)* ','?)? ;
field = attr* vis? id ':' type ;
tfields = (attr* vis? type (',' attr* vis? type)* ','?)? ;
enum = 'enum' id gen? where? '{' (var (',' var)* ','?)? '}' ;
var = attr* id ('{' fields '}' | '(' tfields ')')? ('=' expr)? ;
impl = 'unsafe'? 'impl' gen? '!'? type ('for' type)? where? '{' inner* item* '}' ;
trait = ('unsafe' | 'auto')* 'trait' id gen? (':' bounds)? where? '{' item* '}' ;
mod = 'mod' id (';' | '{' inner* item* '}') ;
const = ('const' | 'static' 'mut'?) (id | '_') ':' type ('=' expr)? ';' ;
gen = '<' (gp (',' gp)* ','?)? '>' ;
gp = attr* ('life' (':' 'life' ('+' 'life')*)? | 'const' id ':' type ('=' ('lit' | block))? | id (':' bounds?)? ('=' type)?) ;
where = 'where' (wp (',' wp)* ','?)? ;
wp = ('for' gen)? type ':' bounds? | 'life' ':' 'life' ('+' 'life')* ;
bounds = bound ('+' bound)* ;
bound = 'life' | '?'? ('for' gen)? path | '(' bound ')' ;
type = ('for' gen)? path | '&' 'life'? 'mut'? type | 'and' 'life'? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '(' (type (',' type)* ','?)? ')'
  | ('unsafe' | 'extern' 'str'?)* 'fn' '(' (ftype (',' ftype)* ','?)? ')' ('->' type)? | ('impl' | 'dyn') bounds | '!' | '_' | qpath | path '!' ('(' tt* ')' | '[' tt* ']' | '{' tt* '}') ;
ftype = (id ':' | '_' ':')? type ;
qpath = '<' type ('as' path)? '>' ('::' seg)+ ;
path = '::'? seg ('::' seg)* ;
seg = (id | 'crate' | 'self' | 'super' | 'Self') ('::'? '<' (ga (',' ga)* ','?)? '>' | '(' (type (',' type)* ','?)? ')' ('->' type)?)? ;
eseg = (id | 'crate' | 'self' | 'super' | 'Self') ;
epath = '::'? eseg ('::' (eseg | '<' (ga (',' ga)* ','?)? '>'))* ;
ga = type | 'life' | id ('=' type | ':' bounds) | 'lit' | '-' 'lit' | block ;
block = '{' inner* stmts '}' ;
stmts = (item | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | ';' | attr* bexpr | attr* expr ';')* (attr* expr)? ;
bexpr = block | 'unsafe' block | 'async' 'move'? block | if | match | ('life' ':')? (loop | while | for | block) ;
loop = 'loop' block ;
while = 'while' cond block ;
for = 'for' pat 'in' expr block ;
if = 'if' cond block ('else' (if | block))? ;
cond = cpart ('and' cpart)* ;
cpart = ('let' pat '=')? expr ;
match = 'match' expr '{' inner* (arm (bexpr ','? | expr ','))* (arm expr)? '}' ;
arm = attr* 'bar'? pat ('bar' pat)* ('if' cond)? '=>' ;
expr = range ;
range = sum (('..' | '..=') sum?)? | ('..' | '..=') sum? ;
sum = unary (bin unary)* ;
bin = 'bin' | '+' | '-' | '*' | '&' | 'and' | 'bar' | '=' | '<' | '>' | '<' '<' | '>' '>' | 'asg' | '>' 'geq' | 'geq' | '<' 'leq' | 'leq' ;
unary = ('-' | '!' | '*' | ('&' | 'and') 'mut'? | '&' 'raw' ('const' | 'mut'))* (post | closure | jump) ;
jump = 'return' expr? | 'break' 'life'? expr? | 'continue' 'life'? | 'yield' expr? ;
closure = ('static' | 'async' | 'move')* ('or' | 'bar' (cp (',' cp)* ','?)? 'bar') ('->' type)? expr ;
cp = pat (':' type)? ;
post = prim tail* ;
tail = '?' | '.' (id ('::' '<' (ga (',' ga)* ','?)? '>')? | 'lit' | 'await') | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' | 'as' type ;
prim = 'lit' | 'str' | epath ('{' sfs '}')? | epath '!' ('(' tt* ')' | '[' tt* ']' | '{' tt* '}') | qpath | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?))? ']' | bexpr | 'const' block ;
sfs = (sf (',' sf)* (',' ('..' expr)?)?)? | '..' expr ;
sf = attr* (id | 'lit') (':' expr)? ;
pat = 'bar'? pu ('bar' pu)* ;
pu = '_' | '..' | plit (('..=' | '..' | '...') plit?)? | '..=' plit | ('&' | 'and') 'mut'? pu | ('ref' | 'mut')* id ('@' pu)? | epath ('(' pats ')' | '{' fpats '}')? (('..=' | '..') plit)? | '(' pats ')' | '[' pats ']' | epath '!' ('(' tt* ')' | '[' tt* ']') | qpath ;
plit = '-'? 'lit' | 'str' ;
pats = (pat (',' pat)* ','?)? ;
fpats = (fpat (',' fpat)* ','?)? ;
fpat = attr* (('ref' | 'mut')* id | (id | 'lit') ':' pat | '..') ;
tt = '(' tt* ')' | '[' tt* ']' | '{' tt* '}' | tok ;
tok = id | 'lit' | 'str' | 'life' | '#' | '!' | 'use' | 'struct' | 'enum' | 'impl' | 'trait' | 'mod' | 'const' | 'static' | 'type' | 'extern' | 'crate' | 'pub' | 'in' | 'self' | 'Self' | 'super'
  | ',' | ';' | ':' | '::' | '*' | '=' | '<' | '>' | '&' | 'and' | 'or' | 'bar' | '+' | '-' | '->' | '=>' | '?' | '.' | '..' | '..=' | '...' | 'bin' | 'asg' | 'geq' | 'leq' | '_' | '@' | 'as' | 'fn' | 'mut' | 'ref'
  | 'where' | 'for' | 'dyn' | 'unsafe' | 'async' | 'await' | 'move' | 'let' | 'else' | 'if' | 'match' | 'while' | 'loop' | 'return' | 'break' | 'continue' | 'yield' | 'raw' | '$' ;
"""

RUBY = """
program = stmts 'data'? ;
stmts = (stmt t | t)* stmt? ;
t = 'nl' | ';' ;
stmt = expr (('if' | 'unless' | 'while' | 'until' | 'rescue') expr)* | 'alias' ('id' | 'sym' | 'const') ('id' | 'sym' | 'const') | 'undef' ('id' | 'sym') | ('BEGIN' | 'END') '{' stmts '}' ;
expr = ('not' | '!')* item (('and' | 'or') ('not' | '!')* item)* ;
item = mlhs '=' rhs | arg | jump ;
jump = ('return' | 'break' | 'next') args? | 'redo' | 'retry' ;
mlhs = star? post (',' star? post)+ | '(' star? post (',' star? post)* ')' (',' star? post)* | star post ;
rhs = args ;
arg = un (bin (un | jump))* ('?' arg ':' arg | '?' 'label' arg)? ('..' un)? ;
bin = 'bin' | '+' | '-' | '*' | '/' | '<' | '>' | '&' | 'bar' | '=' | 'asg' | '..' | '=>' | 'in' | '**' | 'shl' ;
pre = '!' | '~' | 'defined' | 'um' | 'ust' | 'uamp' | 'uss' ;
un = (pre | '-' | '+' | '&' | '*' | '**' | '..')* post ;
post = call ra | lit rb ;
call = 'id' | 'const' | 'fid' | 'super' | 'yield' ;
ra = (dot name ra | par rb | cargs)? ;
rb = (dot name ra | par rb)? ;
par = '(' cargs2 ')' | dot '(' cargs2 ')' | '[' cargs2 ']' | brace | do ;
dot = '.' | '&.' | '::' ;
name = 'id' | 'const' | 'fid' | kw | 'bt' | '+' | '-' | '*' | '/' | '<' | '>' | '!' | 'bin' | '[' ']' ;
kw = 'class' | 'def' | 'if' | 'unless' | 'while' | 'until' | 'rescue' | 'end' | 'begin' | 'ensure' | 'else' | 'elsif' | 'case' | 'when' | 'in' | 'then' | 'do' | 'for' | 'and' | 'or' | 'not' | 'return' | 'break' | 'next' | 'redo' | 'retry' | 'super' | 'yield' | 'self' | 'nil' | 'true' | 'alias' | 'undef' | 'module' | 'defined' | 'BEGIN' | 'END' ;
cargs = carg1 (',' carg)* ;
carg1 = 'label' arg? | 'slabel' arg | pre* post1 (bin (un | jump))* ('?' arg ':' arg | '?' 'label' arg)? | 'not' arg ;
post1 = call ra | lit1 rb | 'ubr' cargs2 ']' rb ;
brace = '{' bparams? stmts '}' ;
do = 'do' bparams? body 'end' ;
bparams = 'bar' bps 'bar' | 'or' ;
bps = (bp (',' bp)* ','?)? (';' 'id' (',' 'id')*)? ;
bp = (star | amp)? 'id' ('=' un)? | star | amp | 'label' arg? | ('(' | 'ubr') bps ')' | '...' ;
star = '*' | '**' | 'ust' | 'uss' ;
amp = '&' | 'uamp' ;
body = stmts ('rescue' (args)? ('=>' post)? ('then' | t) stmts)* ('else' stmts)? ('ensure' stmts)? ;
lit1 = 'num' | 'str'+ | 'sym' | 'regex' | 'ivar' | 'nil' | 'true' | 'self' | '::' 'const' | hash | def | class | if | unless | while | case | for | 'begin' body 'end' | lambda | 'words' ;
lit = lit1 | '(' stmts ')' | ('[' | 'ubr') cargs2 ']' ;
hash = '{' (pair (',' pair)* ','?)? '}' ;
pair = 'label' arg? | arg '=>' arg | ('**' | 'uss') arg | 'slabel' arg ;
lambda = 'lambda' ('(' bps ')' | bps) ('{' stmts '}' | 'do' body 'end') ;
cargs2 = (carg (',' carg)* ','?)? ;
args = carg (',' carg)* ;
carg = 'label' arg? | 'slabel' arg | arg | star | amp | '...' | 'not' arg ;
def = 'def' dname ('(' bps ')' (body 'end' | '=' stmt) | bps t body 'end' | '=' stmt) ;
dname = (('self' | 'const' | 'id' | 'ivar') '.')? ('id' | 'const' | 'fid' | kw | 'label' | '+' | '-' | '*' | '/' | '<' | '>' | '!' | 'bin' | '~' | '**' | 'shl' | '&' | 'bar' | '[' ']' '='? | ('id' | 'const') '=') ;
class = 'class' ('::'? 'const' ('::' 'const')* ('<' expr)? | 'shl' expr) body 'end' | 'module' '::'? 'const' ('::' 'const')* body 'end' ;
if = 'if' stmt ('then' | t) stmts ('elsif' stmt ('then' | t) stmts)* ('else' stmts)? 'end' ;
unless = 'unless' stmt ('then' | t) stmts ('else' stmts)? 'end' ;
while = ('while' | 'until') stmt ('do' | t) stmts 'end' ;
for = 'for' mid 'in' stmt ('do' | t) stmts 'end' ;
mid = 'id' (',' 'id')* ;
case = 'case' stmt? t* (('when' args | 'in' pats) ('then' | t) stmts)+ ('else' stmts)? 'end' ;
pats = pat (',' pat)* (('if' | 'unless') expr)? ;
pat = pp ('bar' pp)* ('=>' 'id')? ;
pp = 'num' | 'str' | 'sym' | 'nil' | 'true' | 'id' | '^' ('id' | 'ivar') | 'const' ('::' 'const')* ('(' pats? ')')? | ('[' | 'ubr') pats? ']' | '{' (lp (',' lp)* ','?)? '}' | star 'id'? | lp | un '..' un? | '..' un | 'regex' ;
lp = 'label' pat? | ('**' | 'uss') ('id' | 'nil') ;
"""

SCSS = """
sheet = (rule | at | decl ';' | ';')* decl? ;
body = (rule | at | decl ';' | ';')* (decl | aline)? ;
rule = sel+ (',' sel*)* '{' body '}' ;
sel = 'id' | 'class' | 'hash' | '&' | '*' | '>' | '+' | '~' | ':' | 'interp' | '[' ('id' | '=' | 'aeq' | 'str' | 'num' | '*' | '~' | '^' | '$' | 'bar' | 'interp')* ']' | 'place' | 'pct' | '(' any* ')' | 'amp' | '-' ;
at = aline ';' | atw (av | ',' | ':')* '{' body '}' ;
aline = atw (av | ',' | ':' | '{' '}')* ;
atw = 'at' ;
decl = ('id' | 'var' | 'interp')+ ':' (v | ',')+ ('imp')* | ('id' | 'interp')+ ':' (v | ',')* '{' body '}' ;
v = 'id' | 'num' | 'pct' | 'str' | 'hash' | 'var' | 'interp' | 'url' | '(' any* ')' | '+' | '-' | '*' | '/' | '=' | 'cmp' | 'imp' | 'class' | '&' | '>' | '<' | 'aeq' | '[' any* ']' | 'place' ;
av = v | '~' | ':' 'id' | '.' | '...' ;
any = v | ',' | ':' | ';' | '.' | '~' | '...' | '{' any* '}' | '^' | '$' | 'bar' | 'at' ;
"""

PYTHON = """
file = (nl | stmt)* ;
nl = 'nl' ;
stmt = simple (';' simple)* ';'? 'nl' | comp ;
block = 'nl' 'indent' stmt+ 'dedent' | simple (';' simple)* ';'? 'nl' ;
simple = 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') id (',' id)* | 'del' exprs | 'assert' expr (',' expr)?
  | 'import' dotted ('as' id)? (',' dotted ('as' id)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | '(' names ','? ')' | names) | exprs (('=' (exprs | yield))* | 'asg' (exprs | yield)) | post ':' expr ('=' (exprs | yield))? | yield | 'type' id ('[' sub ']')? '=' expr ;
dotted = id ('.' id)* ;
names = id ('as' id)? (',' id ('as' id)?)* ;
id = 'id' | 'type' | 'match' | 'case' | '_' ;
yield = 'yield' ('from' expr | exprs)? ;
comp = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? | 'while' named ':' block ('else' ':' block)? | 'async'? 'for' exprs 'in' exprs ':' block ('else' ':' block)?
  | 'try' ':' block (('except' '*'? (expr (',' expr)* ('as' id)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)
  | 'async'? 'with' ('(' with (',' with)* ','? ')' | with (',' with)*) ':' block | deco* ('async'? 'def' id ('[' sub ']')? '(' params ')' ('->' expr)? ':' block | 'class' id ('[' sub ']')? ('(' args ')')? ':' block)
  | 'match' exprs ':' 'nl' 'indent' ('case' exprs ('if' named)? ':' block)+ 'dedent' ;
deco = '@' named 'nl' ;
with = expr ('as' post)? ;
params = (par (',' par)* ','?)? ;
par = ('*' | '**')? id (':' expr)? ('=' expr)? | '*' | '/' ;
lpar = ('*' | '**')? id ('=' expr)? | '*' | '/' ;
named = expr (':=' expr)? ;
exprs = se (',' se)* ','? ;
se = '*'? named ;
expr = 'lambda' (lpar (',' lpar)* ','?)? ':' expr | or ('if' or 'else' expr)? ;
or = not (('and' | 'or') not)* ;
not = 'not'* cmp ;
cmp = un ((bin | 'in' | 'not' 'in' | 'is' 'not'?) 'not'* un)* ;
bin = 'bin' | '+' | '-' | '*' | '**' | '/' | '@' ;
un = ('+' | '-' | '~' | 'await')* post ;
post = prim tail* ;
tail = '.' id | '(' args ')' | '[' sub ']' ;
prim = id | 'num' | 'str'+ | 'None' | '...' | '(' (exprs | yield | named for)? ')' | '[' (exprs | named for)? ']' | '{' (ditem (',' ditem)* ','? | ditem for)? '}' ;
ditem = '**' expr | se (':' expr)? ;
for = ('async'? 'for' exprs 'in' or ('if' or ('if' or 'else' or)?)*)+ ;
args = (ar (',' ar)* ','?)? ;
ar = ('*' | '**')? expr | id '=' expr | named for? ;
sub = sl (',' sl)* ','? ;
sl = expr? ':' expr? (':' expr?)? | se ;
"""

JSON = """
v = 'str' | 'num' | 'word' | '[' (v (',' v)*)? ']' | '{' (p (',' p)*)? '}' ;
p = 'str' ':' v ;
"""

TOML = """
file = 'nl'* (line 'nl'+)* line? ;
line = key '=' v | '[' key ']' | '[[' key ']' ']' ;
key = k ('.' k)* ;
k = 'bare' | 'num' | 'bool' | 'str' ;
v = 'str' | 'mstr' | 'num' | 'val' | 'bool' | '[' 'nl'* (v 'nl'* (',' 'nl'* v 'nl'*)* (',' 'nl'*)?)? ']' | '[[' 'nl'* (v 'nl'* (',' 'nl'* v 'nl'*)* (',' 'nl'*)?)? ']' 'nl'* (',' 'nl'* v 'nl'*)* (',' 'nl'*)? ']' | '{' (key '=' v (',' key '=' v)*)? '}' ;
"""

YAML = """
file = 'dir'* (doc ('sep' doc)*)? ;
doc = 'sep'? (map | seq | 'scalar')? ;
map = (entry)+ ;
entry = 'pair' | 'open' ('indent' (map | seq) 'dedent' | seq)? ;
seq = ('item' | 'iopen' ('indent' (map | seq) 'dedent')? | 'ipair' ('indent' map 'dedent')? | 'ikey' ('indent' (map | seq) 'dedent')?)+ ;
"""

#: Flow collections within a YAML document.
YAML_FLOW = """
v = '[' (e (',' e)* ','?)? ']' | '{' (e (',' e)* ','?)? '}' ;
e = n (':' n?)? | ':' n? ;
n = 'plain'+ | 'str' | v ;
"""
