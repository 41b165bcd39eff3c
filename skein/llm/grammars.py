"""Lexers and grammars of the languages whose files are tested for validity.

A lexer turns a text into the names of its tokens; a grammar (see ``derivatives``)
says which sequences of them are files. The grammars are written for recognition:
they leave out precedence and everything that only a compiler's later phases reject.
"""

from __future__ import annotations

import re

from skein.llm.derivatives import Grammar

PYTHON = r"""
file = (NEWLINE | stmt)* ;
stmt = simples | compound ;
simples = simple (';' simple)* ';'? NEWLINE ;
block = simples | NEWLINE INDENT stmt+ DEDENT ;
compound = ifs | 'while' named ':' block elses? | fors | tries | withs | decorator* 'async'? (funcdef | classdef) | 'async' (fors | withs) | matchs ;
ifs = 'if' named ':' block ('elif' named ':' block)* elses? ;
elses = 'else' ':' block ;
fors = 'for' targets 'in' starred ':' block elses? ;
tries = 'try' ':' block (('except' '*'? (exprs ('as' name)?)? ':' block)+ elses? ('finally' ':' block)? | 'finally' ':' block) ;
withs = 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block ;
withitem = expr ('as' target)? ;
decorator = '@' named NEWLINE ;
funcdef = 'def' name typeparams? '(' params? ')' ('->' expr)? ':' block ;
classdef = 'class' name typeparams? ('(' args? ')')? ':' block ;
typeparams = '[' typeparam (',' typeparam)* ','? ']' ;
typeparam = ('*' | '**')? name (':' expr)? ('=' expr)? ;
params = param (',' param)* ','? ;
param = name (':' expr)? ('=' expr)? | '*' (name (':' ('*'? expr))?)? | '**' name (':' expr)? | '/' ;
matchs = 'match' starred ':' NEWLINE INDENT ('case' pattern (',' pattern)* ','? ('if' named)? ':' block)+ DEDENT ;
pattern = patternor ('as' name)? | '*' name ;
patternor = patternatom ('|' patternatom)* ;
patternatom = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | name ('.' name)* ('(' patternargs? ')')? | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | '{' (patternkey (',' patternkey)* ','?)? '}' ;
patternargs = patternarg (',' patternarg)* ','? ;
patternarg = (name '=')? pattern ;
patternkey = '**' name | ('-'? NUM | STR+ | 'None' | 'True' | 'False' | name ('.' name)*) ':' pattern ;
simple = 'pass' | 'break' | 'continue' | 'return' starred? | 'raise' (expr ('from' expr)?)? | 'global' names | 'nonlocal' names | 'del' targets | 'assert' expr (',' expr)? | imports | 'type' name typeparams? '=' expr | exprstmt ;
names = name (',' name)* ;
imports = 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | importnames | '(' importnames ','? ')') ;
importnames = name ('as' name)? (',' name ('as' name)?)* ;
dotted = name ('.' name)* ;
exprstmt = starred (':' expr ('=' rhs)? | AUG rhs | ('=' rhs)*) | yield ('=' rhs)* ;
rhs = starred | yield ;
yield = 'yield' ('from' expr | starred)? ;
starred = star (',' star)* ','? ;
star = '*' expr | named ;
named = expr (':=' expr)? ;
expr = 'lambda' lambdaparams? ':' expr | operation ('if' operation 'else' expr)? ;
exprs = expr (',' expr)* ','? ;
lambdaparams = lambdaparam (',' lambdaparam)* ','? ;
lambdaparam = name ('=' expr)? | '*' name? | '**' name | '/' ;
operation = operand (binary operand)* ;
operand = ('not' | '-' | '+' | '~' | 'await')* primary ;
binary = 'and' | 'or' | 'in' | 'is' | 'is' 'not' | 'not' 'in' | '|' | '*' | '**' | '/' | '-' | '+' | '@' | BIN ;
primary = atom trailer* ;
trailer = '(' args? ')' | '[' subscripts ']' | '.' name ;
args = arg (',' arg)* ','? ;
arg = named comp* | name '=' expr | '*' expr | '**' expr ;
subscripts = subscript (',' subscript)* ','? ;
subscript = star | expr? ':' expr? (':' expr?)? ;
atom = name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (yield | star (comp+ | (',' star)* ','?))? ')' | '[' (star (comp+ | (',' star)* ','?))? ']' | '{' (entry (comp+ | (',' entry)* ','?) | star (comp+ | (',' star)* ','?))? '}' ;
entry = expr ':' expr | '**' expr ;
comp = 'async'? 'for' targets 'in' operation ('if' compcond)* ;
compcond = operation | 'lambda' lambdaparams? ':' operation | operation ':=' operation ;
targets = target (',' target)* ','? ;
target = '*'? primary ;
name = ID | 'match' | 'case' | 'type' ;
"""

_JS = r"""
file = stmt* ;
block = '{' stmt* '}' ;
stmt = block | ';' | vars ';' | 'if' '(' expr ')' stmt ('else' stmt)? | fors | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'do' stmt 'while' '(' expr ')' | switch | tries | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') name? ';' | decorator* function | decorator* class | name ':' stmt | expr \ ('{' | 'function' | 'class') ';' | 'debugger' ';' | imports | exports DECLARATIONS ;
vars = ('var' | 'let' | 'const') var (',' var)* ;
var = binding OPTTYPE ('=' assign)? ;
binding = name | pattern ;
pattern = '[' ','* (element (','+ element)* ','*)? ']' | '{' (property (',' property)* ','?)? '}' ;
element = '...'? binding ('=' assign)? ;
property = '...' name | anykey (':' binding)? ('=' assign)? ;
fors = 'for' 'await'? '(' ((vars | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') binding | primary trailer*) ('of' | 'in') expr) ')' stmt ;
switch = 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}' ;
tries = 'try' block ('catch' ('(' binding OPTTYPE ')')? block ('finally' block)? | 'finally' block) ;
imports = 'import' (STR | importclause 'from' STR) (('with' | 'assert') object)? ';' ;
importclause = TYPEWORD (name (',' ('*' 'as' name | importnames))? | '*' 'as' name | importnames) ;
importnames = '{' (importname (',' importname)* ','?)? '}' ;
importname = TYPEWORD (anyname | STR) ('as' anyname)? ;
exports = 'export' ( 'default' (assign ';' | 'async'? function | decorator* class) | TYPEWORD ('*' ('as' anyname)? | importnames) 'from' STR ';' | TYPEWORD importnames ';' | vars ';' | function | decorator* class EXPORTED) ;
function = 'async'? 'function' '*'? name? TYPEPARAMS '(' params ')' OPTTYPE BODY ;
params = (param (',' param)* ','?)? ;
param = decorator* MODIFIERS '...'? binding OPTIONAL OPTTYPE ('=' assign)? THISPARAM ;
class = ABSTRACT 'class' name? TYPEPARAMS ('extends' primary trailer* )? IMPLEMENTS '{' (member | ';')* '}' ;
member = decorator* MODIFIERS ( ('get' | 'set' | 'async' | '*' | 'async' '*')? key OPTIONAL TYPEPARAMS '(' params ')' OPTTYPE BODY | key OPTIONAL OPTTYPE ('=' assign)? ';' | 'static' block INDEXER ) ;
decorator = '@' name ('.' anyname)* TYPEARGS ('(' args ')')? ;
key = anykey | '[' assign ']' | PRIVATE ;
anykey = anyname | STR | NUM | '[' assign ']' ;
expr = assign (',' assign)* ;
assign = operand (BINARY operand | '?' assign ':' operand)* ;
operand = (PRE | '-' | '+' | 'new' | 'await')* (arrow | primary trailer* '++'? | primary trailer* '--') | ('++' | '--') operand | 'yield' '*'? assign? ;
arrow = 'async'? (name | TYPEPARAMS '(' params ')' OPTTYPE) '=>' (block | assign \ ('{')) ;
primary = name | NUM | STR | RX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | array | object | function | class | 'import' '(' assign ')' | 'import' '.' name | PRIVATE ;
trailer = '.' anyname | '.' PRIVATE | '?.' (anyname | '(' args ')' | '[' expr ']') | '(' args ')' | '[' expr ']' | STR CASTS ;
args = (arg (',' arg)* ','?)? ;
arg = '...'? assign ;
array = '[' ','* (arg (','+ arg)* ','*)? ']' ;
object = '{' (objectentry (',' objectentry)* ','?)? '}' ;
objectentry = '...' assign | name ('=' assign)? | key ':' assign | ('get' | 'set' | 'async' | '*' | 'async' '*')? key TYPEPARAMS '(' params ')' OPTTYPE block ;
BINARY = BIN | '*' | '-' | '+' | '=' | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '>' '>=' | '>' '>' '>=' | 'in' | 'instanceof' | '|' | '&' ;
name = ID | 'of' | 'get' | 'set' | 'async' | 'from' | 'as' | 'static' | 'let' | 'with' | 'assert' SOFT ;
anyname = name | 'var' | 'const' | 'if' | 'else' | 'for' | 'while' | 'do' | 'switch' | 'case' | 'default' | 'try' | 'catch' | 'finally' | 'return' | 'throw' | 'break' | 'continue' | 'debugger' | 'import' | 'export' | 'function' | 'class' | 'extends' | 'new' | 'await' | 'yield' | 'this' | 'super' | 'null' | 'true' | 'false' | 'in' | 'instanceof' | PRE ;
"""

_TS = r"""
declaration = 'declare' (vars ';' | function | class | 'global' block) | 'declare'? (interface | typealias | enum | ('namespace' | 'module') (name ('.' name)* | STR) block | 'module' STR ';') | 'import' name '=' expr ';' ;
interface = 'interface' name typeparams ('extends' type (',' type)*)? typebody ;
typealias = 'type' name typeparams '=' type ';' ;
enum = 'const'? 'enum' name '{' (anykey ('=' assign)? (',' anykey ('=' assign)?)* ','?)? '}' ;
typeparams = ('<' typeparam (',' typeparam)* ','? '>')? ;
typeparam = 'const'? ('in' | 'out')? name ('extends' type)? ('=' type)? ;
typeargs = '<' type (',' type)* ','? '>' ;
opttype = (':' type)? ;
type = ('|' | '&')? typeunit (('|' | '&') typeunit)* ('extends' type '?' type ':' type)? ;
typeunit = ('keyof' | 'readonly' | 'typeof' | 'infer' | 'unique' | 'asserts')* typeatom ('[' type? ']')* ('is' type)? ;
typeatom = (name | 'this' | 'void' | 'null' | 'true' | 'false') ('.' anyname)* typeargs? | 'import' '(' STR ')' ('.' anyname)* typeargs? | '-'? NUM | STR | typebody | '[' (tupleitem (',' tupleitem)* ','?)? ']' | '(' type ')' | 'abstract'? 'new'? typeparams '(' params ')' '=>' type ;
tupleitem = '...'? (name '?'? ':')? type '?'? ;
typebody = '{' (typemember (',' | ';'))* typemember? '}' ;
typemember = ('readonly' | '-' | '+')* ( ('get' | 'set')? anykey '?'? opttype | 'new'? anykey? '?'? typeparams '(' params ')' opttype | '[' name (':' | 'in') type ('as' type)? ']' '?'? '-'? opttype ) ;
mods = ('public' | 'private' | 'protected' | 'static' | 'abstract' | 'readonly' | 'override' | 'declare' | 'accessor')* ;
"""


def _javascript(ts: bool) -> str:
    fill = {
        "DECLARATIONS": "| declaration" if ts else "",
        "EXPORTED": "| declaration | '=' expr ';' | 'as' 'namespace' name ';'" if ts else "",
        "OPTTYPE": "opttype" if ts else "",
        "TYPEPARAMS": "typeparams" if ts else "",
        "THISPARAM": "| 'this' opttype" if ts else "",
        "TYPEWORD": "'type'?" if ts else "",
        "MODIFIERS": "mods" if ts else "'static'?",
        "OPTIONAL": "('?' | '!')?" if ts else "",
        "BODY": "(block | ';')" if ts else "block",
        "ABSTRACT": "'abstract'?" if ts else "",
        "IMPLEMENTS": "typeargs? ('implements' type (',' type)*)?" if ts else "",
        "TYPEARGS": "typeargs?" if ts else "",
        "INDEXER": "| '[' name ':' type ']' opttype ';'" if ts else "",
        "CASTS": "| '!' | ('as' | 'satisfies') ('const' | type) | typeargs ('(' args ')' | STR)" if ts else "",
        "SOFT": "".join(f" | '{w}'" for w in "type interface declare namespace module abstract readonly public private protected is keyof infer enum override unique asserts global implements satisfies accessor out".split()) if ts else "",
    }
    text = re.sub(r"\b(" + "|".join(fill) + r")\b", lambda m: fill[m[1]], _JS).replace("BINARY", "binop")
    if not ts:
        return text.replace("| PRE ;", "| PRE | 'enum' ;").replace("('[' assign ']' | ", "")
    return text.replace("(PRE |", "(PRE | '!' | 'typeof' | 'void' |").replace("| PRE ;", "| PRE | 'typeof' | 'void' | 'const' ;") + _TS


_JAVA = r"""
file = (annotation* 'package' qname ';')? (import | ';')* (typedecl | ';')* ;
import = 'import' 'static'? qname ('.' '*')? ';' ;
qname = name ('.' name)* ;
annotation = '@' qname ('(' (annoarg (',' annoarg)*)? ')')? ;
annoarg = (name '=')? annovalue ;
annovalue = expr | annotation | '{' (annovalue (',' annovalue)* ','?)? '}' ;
mods = (annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')* ;
typedecl = mods (class | interface | enum | record | annotype) ;
class = 'class' name typeparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody ;
interface = 'interface' name typeparams? ('extends' types)? ('permits' types)? classbody ;
record = 'record' name typeparams? '(' params ')' ('implements' types)? classbody ;
annotype = '@' 'interface' name '{' (typedecl | mods type name ('(' ')' ('default' annovalue)? | '=' init) ';' | ';')* '}' ;
enum = 'enum' name ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}' ;
constant = annotation* name ('(' args ')')? classbody? ;
classbody = '{' member* '}' ;
member = ';' | 'static'? block | typedecl | mods (typeparams? (type | 'void') name '(' params ')' dims throws? (block | ';') | typeparams? name '(' params ')' throws? block | name block | type vars ';') ;
throws = 'throws' types ;
types = type (',' type)* ;
typeparams = '<' typeparam (',' typeparam)* '>' ;
typeparam = annotation* name ('extends' type ('&' type)*)? ;
type = annotation* (PRIM | name typeargs? ('.' annotation* name typeargs?)*) dims ;
typeargs = '<' (typearg (',' typearg)*)? '>' ;
typearg = type | annotation* '?' (('extends' | 'super') type)? ;
dims = (annotation* '[' ']')* ;
params = (param (',' param)*)? ;
param = mods type '...'? (name | 'this') dims ;
vars = var (',' var)* ;
var = name dims ('=' init)? ;
init = expr | '{' (init (',' init)* ','?)? '}' ;
block = '{' stmt* '}' ;
stmt = block | ';' | local ';' | mods (class | interface | enum | record) | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (mods type name ':' expr | (local | exprs)? ';' expr? ';' exprs?) ')' stmt | tries | switch | 'synchronized' '(' expr ')' block | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') name? ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | name ':' stmt | expr ';' ;
local = ('final' | annotation)* type vars ;
exprs = expr (',' expr)* ;
tries = 'try' ('(' resource (';' resource)* ';'? ')')? block catch* ('finally' block)? ;
resource = ('final' | annotation)* type name '=' expr | expr ;
catch = 'catch' '(' ('final' | annotation)* type ('|' type)* name ')' block ;
switch = 'switch' '(' expr ')' '{' case* '}' ;
case = ('case' caselabel (',' caselabel)* ('when' expr)? | 'default') (':' stmt* | '->' (expr ';' | block | 'throw' expr ';')) ;
caselabel = expr | type name | 'default' ;
expr = operand (binary operand | '?' expr ':' operand | 'instanceof' 'final'? type name?)* ;
operand = (PRE | '-' | '+')* (lambda | switch | primary trailer* POST? | '(' type ('&' type)* ')' operand) ;
lambda = (name | '(' (name (',' name)* | params) ')') '->' (expr | block) ;
primary = name | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | new | type '::' (name | 'new') | (PRIM | 'void') dims '.' 'class' ;
new = 'new' annotation* (PRIM | name typeargs? ('.' name typeargs?)*) ('(' args ')' classbody? | ('[' expr? ']')+ arrayinit?) ;
arrayinit = '{' (init (',' init)* ','?)? '}' ;
trailer = '.' typeargs? (name | 'this' | 'super' | 'class' | new) | '(' args ')' | '[' expr ']' | dims '.' 'class' | '::' (name | 'new') ;
args = (expr (',' expr)*)? ;
binary = BIN | '-' | '+' | '*' | '=' | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '>' '>=' | '>' '>' '>=' | '&' | '|' ;
name = ID | 'record' | 'sealed' | 'permits' | 'yield' | 'when' | 'non' ;
"""

_CSHARP = r"""
file = (extern | using)* (attrs)* (namespaced | filescoped)  ;
extern = 'extern' ID ID ';' ;
using = 'global'? 'using' 'static'? (name '=')? type ';' ;
filescoped = 'namespace' qname ';' using* (typedecl | ';')* ;
namespaced = (namespace | typedecl | ';' | toplevel)* ;
toplevel = stmt ;
namespace = 'namespace' qname '{' using* (namespace | typedecl)* '}' ';'? ;
qname = name ('.' name)* ;
attrs = '[' (name ':')? attr (',' attr)* ','? ']' ;
attr = type ('(' args ')')? ;
mods = ('public' | 'private' | 'protected' | 'internal' | 'static' | 'readonly' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'async' | 'partial' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'const' | 'required' | 'file' | 'ref')* ;
typedecl = attrs* mods (class | enum | delegate) ;
class = ('class' | 'struct' | 'interface' | 'record' | 'record' ('class' | 'struct')) name typeparams? ('(' params ')')? (':' base (',' base)*)? where* ('{' member* '}' ';'? | ';') ;
base = type ('(' args ')')? ;
enum = 'enum' name (':' type)? '{' (attrs* name ('=' expr)? (',' attrs* name ('=' expr)?)* ','?)? '}' ';'? ;
delegate = 'delegate' type name typeparams? '(' params ')' where* ';' ;
typeparams = '<' attrs* ('in' | 'out')? name (',' attrs* ('in' | 'out')? name)* '>' ;
where = 'where' name ':' constraint (',' constraint)* ;
constraint = type | 'class' '?'? | 'struct' | 'new' '(' ')' | 'default' ;
member = typedecl | ';' | attrs* mods memberrest ;
memberrest = type explicit? name typeparams? '(' params ')' where* body | name '(' params ')' (':' ('base' | 'this') '(' args ')')? body | '~' name '(' ')' body | type explicit? name (accessors ('=' expr ';')? | '=>' expr ';') | type explicit? 'this' '[' params ']' (accessors | '=>' expr ';') | type vars ';' | 'event' type (vars ';' | name accessors) | ('implicit' | 'explicit') 'operator' type '(' params ')' body | type 'operator' anyop '(' params ')' body ;
explicit = (name typeargs? '.')+ ;
anyop = binary | PRE | 'true' | 'false' | '!' | '++' | '--' ;
accessors = '{' (attrs* mods ('get' | 'set' | 'init' | 'add' | 'remove') body)+ '}' ;
body = block | '=>' expr ';' | ';' ;
params = (param (',' param)*)? ;
param = attrs* ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* type name ('=' expr)? ;
type = ('ref' 'readonly'?)? (PRIM | 'void' | 'var' | (name '::')? name typeargs? ('.' name typeargs?)* | '(' type name? (',' type name?)+ ')') ('?' | '[' ','* ']' | '*')* ;
typeargs = '<' (type (',' type)* | ','*) '>' ;
vars = var (',' var)* ;
var = name ('=' init)? ;
init = expr | arrayinit ;
arrayinit = '{' (init (',' init)* ','?)? '}' ;
block = '{' stmt* '}' ;
stmt = block | ';' | local ';' | localfunction | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (local | exprs)? ';' expr? ';' exprs? ')' stmt | 'await'? 'foreach' '(' (type name | 'var' tuplenames) 'in' expr ')' stmt | tries | 'switch' '(' expr ')' '{' (('case' casepattern ('when' expr)? | 'default') ':' stmt*)* '}' | 'await'? 'using' '(' (local | expr) ')' stmt | 'await'? 'using' local ';' | 'lock' '(' expr ')' stmt | ('checked' | 'unchecked' | 'unsafe') block | 'fixed' '(' local ')' stmt | 'return' expr? ';' | 'throw' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' (name | 'case' expr | 'default') ';' | 'yield' ('return' expr | 'break') ';' | name ':' stmt | expr ';' ;
local = 'const'? type vars | 'var' tuplenames '=' expr ;
tuplenames = '(' name (',' name)+ ')' ;
localfunction = attrs* ('static' | 'async' | 'unsafe' | 'extern')* type name typeparams? '(' params ')' where* body ;
exprs = expr (',' expr)* ;
tries = 'try' block ('catch' ('(' type name? ')')? ('when' '(' expr ')')? block)* ('finally' block)? ;
expr = operand (binary operand | '?' expr ':' operand | 'is' pattern | 'as' type | 'switch' '{' (arm (',' arm)* ','?)? '}' | 'with' arrayinit)* ;
arm = pattern ('when' expr)? '=>' expr ;
casepattern = pattern ;
pattern = patternunit (('and' | 'or') patternunit)* ;
patternunit = 'not'* (operand | type name? | type? '{' (subpattern (',' subpattern)* ','?)? '}' name? | type? '(' (subpattern (',' subpattern)*)? ')' name? | ('<' | '>' | '>=' | BIN) operand | 'var' name | '[' (pattern (',' pattern)*)? ']') ;
subpattern = (name ('.' name)* ':')? pattern ;
operand = (PRE | '!' | '-' | '+' | '&' | '*' | '++' | '--' | '^' | 'await' | 'throw' | 'ref' | '~')* (lambda | primary trailer* ('++' | '--')? | '(' type ')' operand | query) | '..' operand? ;
lambda = attrs* ('async' | 'static')* (name | '(' lambdaparams ')') '=>' (expr | block) | 'async'? 'delegate' ('(' params ')')? block ;
lambdaparams = (name (',' name)* | params) ;
query = 'from' type? name 'in' expr ('from' type? name 'in' expr | 'let' name '=' expr | 'where' expr | 'join' type? name 'in' expr 'on' expr 'equals' expr ('into' name)? | 'orderby' expr ('ascending' | 'descending')? (',' expr ('ascending' | 'descending')?)*)* ('select' expr | 'group' expr 'by' expr) ('into' name)? ;
primary = name typeargs? | (name '::')? name | PRIM | NUM | STR | 'this' | 'base' | 'null' | 'true' | 'false' | '(' args ')' | new | 'typeof' '(' type ')' | 'default' ('(' type ')')? | ('nameof' | 'sizeof' | 'checked' | 'unchecked') '(' expr ')' | 'stackalloc' type '[' expr ']' | '[' (collection (',' collection)* ','?)? ']' ;
collection = '..'? expr ;
new = 'new' type ('(' args ')')? objectinit? | 'new' '(' args ')' objectinit? | 'new' objectinit | 'new' type? '[' exprs? ']' ('[' ','* ']')* arrayinit? | 'new' '[' ','* ']' arrayinit ;
objectinit = '{' (objectentry (',' objectentry)* ','?)? '}' ;
objectentry = (name | '[' args ']') '=' init | init ;
trailer = '.' name typeargs? | '?' '.' name typeargs? | '->' name | '(' args ')' | '?'? '[' args ']' | '!' ;
args = (arg (',' arg)*)? ;
arg = (name ':')? ('ref' | 'out' | 'in')* (expr | type name) ;
binary = BIN | '-' | '+' | '*' | '=' | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '>' '>=' | '&' | '|' | '^' | '??' | '..' ;
name = ID | 'get' | 'set' | 'init' | 'add' | 'remove' | 'partial' | 'async' | 'where' | 'when' | 'global' | 'record' | 'required' | 'file' | 'scoped' | 'nameof' | 'from' | 'let' | 'join' | 'on' | 'equals' | 'into' | 'orderby' | 'ascending' | 'descending' | 'select' | 'group' | 'by' | 'and' | 'or' | 'not' | 'yield' | 'with' | 'await' | 'var' ;
"""

_GO = r"""
file = 'package' ID ';' import* (top ';')* ;
import = 'import' (importspec | '(' (importspec ';')* importspec? ')') ';' ;
importspec = (ID | '.')? STR ;
top = decl | 'func' ID typeparams? signature block? | 'func' '(' param ','? ')' ID signature block? ;
decl = 'var' (varspec | '(' (varspec ';')* varspec? ')') | 'const' (constspec | '(' (constspec ';')* constspec? ')') | 'type' (typespec | '(' (typespec ';')* typespec? ')') ;
ids = ID (',' ID)* ;
varspec = ids (type ('=' exprs)? | '=' exprs) ;
constspec = ids (type? '=' exprs)? ;
typespec = ID typeparams? '='? type ;
typeparams = '[' typeparam (',' typeparam)* ','? ']' ;
typeparam = ids constraint ;
constraint = '~'? type ('|' '~'? type)* ;
signature = '(' params? ')' (result)? ;
result = '(' params? ')' | type ;
params = param (',' param)* ','? ;
param = ID? '...'? type ;
type = ID ('.' ID)? ('[' type (',' type)* ','? ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (methodspec ';')* methodspec? '}' | '(' type ')' ;
field = (ids type | '*'? ID ('.' ID)? typeargs?) STR? ;
typeargs = '[' type (',' type)* ']' ;
methodspec = ID signature | constraint ;
block = '{' stmts '}' ;
stmts = (stmt? ';')* stmt? ;
stmt = decl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | ifs | switch | select | fors | ('go' | 'defer') expr | ID ':' stmt? ;
simple = exprs (('=' | ':=' | AUG) exprs | '++' | '--' | '<-' expr)? ;
ifs = 'if' (simple? ';')? expr block ('else' (ifs | block))? ;
switch = 'switch' (simple? ';')? simple? '{' (('case' (expr | type) (',' (expr | type))* | 'default') ':' stmts)* '}' ;
select = 'select' '{' (('case' simple | 'default') ':' stmts)* '}' ;
fors = 'for' (expr? | simple? ';' expr? ';' simple? | (exprs ('=' | ':='))? 'range' expr) block ;
exprs = expr (',' expr)* ;
expr = operand (binary operand)* ;
operand = (PRE | '-' | '+' | '*' | '&' | '<-' | '^')* primary trailer* ;
primary = ID | NUM | STR | '(' (expr | type) ')' | 'func' signature block | composite | type '(' expr ','? ')' ;
composite = ('[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}') elements? ;
elements = '{' (element (',' element)* ','?)? '}' ;
element = (value ':')? value ;
value = expr | elements ;
trailer = '.' ID | '.' '(' (type | 'type') ')' | '[' index ']' | '(' args ')' | elements ;
index = (expr | type) (',' (expr | type))* ','? | expr? ':' expr? (':' expr)? ;
args = (arg (',' arg)* '...'? ','?)? ;
arg = expr | type ;
binary = BIN | '-' | '+' | '*' | '&' | '|' | '^' | '~' ;
"""

_RUST = r"""
file = innerattr* item* ;
innerattr = '#' '!' '[' tokens ']' ;
attr = '#' '[' tokens ']' ;
tokens = token* ;
token = ANY | '(' tokens ')' | '[' tokens ']' | '{' tokens '}' ;
vis = ('pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')?)? ;
item = attr* vis (use | mod | fn | struct | enum | trait | impl | const | typealias | externs | union | macrorules | macrocall) ;
use = 'use' usetree ';' ;
usetree = '::'? (pathword '::')* (pathword ('as' ID)? | '*' | '{' (usetree (',' usetree)* ','?)? '}') ;
mod = 'unsafe'? 'mod' ID (';' | '{' innerattr* item* '}') ;
externs = 'unsafe'? 'extern' ('crate' ID ('as' ID)? ';' | STR? '{' item* '}') ;
fn = ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID generics? '(' (fnparam (',' fnparam)* ','?)? ')' ('->' type)? where? (block | ';') ;
fnparam = attr* (('&' LIFE?)? 'mut'? 'self' (':' type)? | pattern ':' type | '...') ;
struct = 'struct' ID generics? (where? '{' (structfield (',' structfield)* ','?)? '}' | '(' (tuplefield (',' tuplefield)* ','?)? ')' where? ';' | ';') ;
union = 'union' ID generics? where? '{' (structfield (',' structfield)* ','?)? '}' ;
structfield = attr* vis ID ':' type ;
tuplefield = attr* vis type ;
enum = 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}' ;
variant = attr* ID ('{' (structfield (',' structfield)* ','?)? '}' | '(' (tuplefield (',' tuplefield)* ','?)? ')')? ('=' expr)? ;
trait = 'unsafe'? 'trait' ID generics? (':' bounds)? where? '{' assoc* '}' ;
impl = 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' innerattr* assoc* '}' ;
assoc = attr* vis 'default'? (fn | const | 'type' ID generics? (':' bounds)? where? ('=' type)? where? ';' | macrocall) ;
const = ('const' | 'static') 'mut'? (ID | '_') (':' type)? ('=' expr)? ';' ;
typealias = 'type' ID generics? where? '=' type ';' ;
macrorules = ID '!' ID (('(' tokens ')' | '[' tokens ']') ';' | '{' tokens '}') ;
macrocall = path '!' (('(' tokens ')' | '[' tokens ']') ';' | '{' tokens '}') ;
generics = '<' (generic (',' generic)* ','?)? '>' ;
generic = attr* (LIFE (':' bounds)? | ID (':' bounds)? ('=' type)? | 'const' ID ':' type ('=' expr)?) ;
where = 'where' ((type | LIFE | 'for' generics type) ':' bounds (',' (type | LIFE | 'for' generics type) ':' bounds)* ','?)? ;
bounds = (bound ('+' bound)* '+'?)? ;
bound = LIFE | '?'? ('for' generics)? path | '(' '?'? path ')' ;
type = '&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '(' (type (',' type)* ','?)? ')' | '[' type (';' expr)? ']' | '!' | '_' | ('impl' | 'dyn') bounds | ('for' generics)? path | 'unsafe'? ('extern' STR?)? 'fn' '(' (fntypeparam (',' fntypeparam)* ','?)? ')' ('->' type)? | '<' type ('as' path)? '>' '::' path | path '!' ('(' tokens ')' | '[' tokens ']' | '{' tokens '}') ;
fntypeparam = (ID ':' | '_' ':')? type ;
path = '::'? segment ('::' segment)* ;
segment = pathword (genericargs | '::' genericargs | '(' (type (',' type)* ','?)? ')' ('->' type)?)? ;
pathword = ID | 'self' | 'super' | 'crate' | 'union' | 'default' ;
genericargs = '<' (genericarg (',' genericarg)* ','?)? '>' ;
genericarg = LIFE | type | ID '=' type | ID ':' bounds | NUM | STR | '-' NUM | block | 'true' | 'false' ;
pattern = '|'? patternunit ('|' patternunit)* ;
patternunit = 'ref'? 'mut'? ID ('@' patternunit)? | '_' | '..' | '&' 'mut'? patternunit | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | literal (('..' | '..=' | '...') literal?)? | ('..=' | '..') literal | exprpath ('{' (attr* fieldpattern (',' attr* fieldpattern)* ','?)? '}' | '(' (pattern (',' pattern)* ','?)? ')' | ('..' | '..=') literal)? | 'const' block | path '!' ('(' tokens ')' | '[' tokens ']') | 'box' patternunit ;
fieldpattern = ID ':' pattern | NUM ':' pattern | 'ref'? 'mut'? ID | '..' ;
literal = '-'? NUM | STR | 'true' | 'false' | exprpath ;
exprpath = '::'? pathword ('::' (pathword | genericargs))* | '<' type ('as' path)? '>' ('::' (pathword | genericargs))+ ;
block = 'unsafe'? '{' innerattr* stmt* expr? '}' ;
stmt = ';' | item | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* blocklike ;
blocklike = (LIFE ':')? (block | 'if' expr block ('else' 'if' expr block)* ('else' block)? | 'match' expr '{' innerattr* (arm)* '}' | 'loop' block | 'while' expr block | 'for' pattern 'in' expr block | 'async' 'move'? block | 'const' block) ;
arm = attr* pattern ('if' expr)? '=>' (expr ','? | blocklike ','?) ;
expr = operand (binary operand | 'as' type | ('..' | '..=') operand?)* | ('..' | '..=') operand? ;
operand = ('-' | '*' | '!' | '&' 'mut'? | '&' 'raw' ('const' | 'mut') | 'let' pattern '=' | 'box')* (closure | primary trailer* | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'yield' expr?) ;
closure = 'static'? 'async'? 'move'? '|' (closureparam (',' closureparam)* ','?)? '|' ('->' type block | expr) | 'async'? 'move'? '||' ('->' type block | expr) ;
closureparam = attr* patternunit (':' type)? ;
primary = NUM | STR+ | 'true' | 'false' | exprpath | exprpath structinit | exprpath '!' ('(' tokens ')' | '[' tokens ']' | '{' tokens '}') | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' | blocklike | '_' ;
structinit = '{' (fieldinit (',' fieldinit)* (',' '..' expr)? ','? | '..' expr)? '}' ;
fieldinit = attr* (ID | NUM) (':' expr)? ;
trailer = '?' | '.' (ID ('::' genericargs)? | NUM | 'await' | 'default' | 'union') | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' ;
binary = BIN | '-' | '+' | '*' | '&' | '|' | '||' | '=' | '<' | '>' | '>' '>' | '>=' | '>' '>=' ;
"""

_RUBY = r"""
file = stmts ;
stmts = (NL | ';')* (stmt ((NL | ';')+ stmt)* (NL | ';')*)? ;
stmt = line (('if' | 'unless' | 'while' | 'until' | 'rescue') line)* ;
line = 'not'* item (('and' | 'or') NL* 'not'* item)* ;
item = expr | command | 'return' callargs? | ('break' | 'next') callargs? | 'redo' | 'retry' | 'alias' fname fname | 'undef' fname | lhs (',' lhs)* ','? '=' NL* (splat (',' splat)* | command) | lhs AUG NL* command | lhs '=' NL* expr 'rescue' expr | ('BEGIN' | 'END') '{' stmts '}' ;
lhs = '*'? operand | '(' lhs (',' lhs)* ')' ;
fname = anyname | SYM | operator ;
operator = BIN | '-' | '+' | '*' | '[' ']' '='? | '!' | '~' | '<' | '>' | '|' | '&' | '**' | '<<' ;
splat = ('*' | '**' | '&')? expr ;
command = operand callargs (doblock callchain*)? | 'yield' callargs | 'super' callargs ;
callchain = ('.' | '&.') anyname ('(' parenargs ')')? (doblock | braceblock)? ;
callargs = callarg (',' NL* callarg)* ;
callarg = ('*' | '**' | '&')? expr | LABEL NL* expr | LABEL | expr '=>' NL* expr | STR ':' NL* expr | command ;
expr = ternary (('=' | AUG) NL* ternary)* ;
ternary = range ('?' NL* ternary NL* (':' | NL* ':') NL* ternary)? | range '?' NL* ID LABELSPLIT ternary ;
range = operation (('..' | '...') operation?)? | ('..' | '...') operation ;
operation = operand (binary NL* operand)* ;
binary = BIN | '-' | '+' | '*' | '<' | '>' | '|' | '||' | '&' | '**' | '<<' | 'in' ;
operand = ('!' | '-' | '+' | '~' | '&' | 'defined?')* primary trailer* ;
trailer = ('.' | '&.' | '::') (anyname | '(' parenargs ')') | '::' CONST | '(' parenargs ')' | '[' NL* (callargs ','? NL*)? ']' | braceblock | doblock ;
parenargs = NL* (callarg (',' NL* callarg)* ','? NL*)? ;
braceblock = '{' blockparams? stmts '}' ;
doblock = 'do' blockparams? bodystmts 'end' ;
blockparams = '|' (blockparam (',' blockparam)* ','?)? (';' ID (',' ID)*)? '|' | '||' ;
blockparam = ('*' | '**' | '&')? ID ('=' operation)? | '*' | LABEL operation? | '(' blockparam (',' blockparam)* ')' ;
bodystmts = stmts (rescues+ ('else' stmts)?)? ('ensure' stmts)? ;
rescues = 'rescue' (splat (',' NL* splat)*)? ('=>' lhs)? ('then' | NL | ';') stmts ;
primary = anyid | CONST | NUM | STR+ | SYM | RX | 'nil' | 'true' | 'false' | 'self' | '__method__' | '::' CONST | '[' NL* (callargs ','? NL*)? ']' | hash | '(' stmts ')' | lambda | 'yield' ('(' parenargs ')')? | 'super' | ifs | whiles | case | fors | 'begin' bodystmts 'end' | def | class | module ;
hash = '{' NL* (pair (NL* ',' NL* pair)* ','? NL*)? '}' ;
pair = LABEL NL* expr | LABEL | expr NL* '=>' NL* expr | STR ':' NL* expr | '**' expr ;
lambda = '->' ('(' params ')' | params)? ('{' stmts '}' | 'do' bodystmts 'end') ;
ifs = ('if' | 'unless') line then stmts ('elsif' line then stmts)* ('else' stmts)? 'end' ;
then = (NL | ';')* ('then' | NL | ';') ;
whiles = ('while' | 'until') line ('do' | NL | ';') stmts 'end' ;
fors = 'for' lhs (',' lhs)* 'in' line ('do' | NL | ';') stmts 'end' ;
case = 'case' line? (NL | ';')* (('when' splat (',' NL* splat)* then stmts)+ | ('in' casepattern (('if' | 'unless') line)? then stmts)+) ('else' stmts)? 'end' ;
casepattern = callargs | '{' NL* callargs '}' ;
def = 'def' (('self' | ID | CONST) '.')? defname ('(' NL* params NL* ')' | params)? ('=' NL* line | (NL | ';') bodystmts 'end' | ';'? bodystmts 'end') ;
defname = anyname | anyname '=' | operator ;
params = (param (',' NL* param)*)? ;
param = ID ('=' expr)? | LABEL expr? | ('*' | '**') ID? | '&' ID? | '...' | '(' params ')' | '**' 'nil' ;
class = 'class' (cpath ('<' line)? | '<<' line) (NL | ';') bodystmts 'end' ;
module = 'module' cpath (NL | ';')? bodystmts 'end' ;
cpath = '::'? CONST ('::' CONST)* ;
anyid = ID ;
anyname = ID | CONST | 'class' | 'end' | 'if' | 'unless' | 'while' | 'until' | 'rescue' | 'begin' | 'def' | 'do' | 'then' | 'else' | 'elsif' | 'case' | 'when' | 'in' | 'for' | 'module' | 'return' | 'break' | 'next' | 'nil' | 'true' | 'false' | 'self' | 'super' | 'yield' | 'and' | 'or' | 'not' | 'ensure' | 'retry' | 'redo' | 'alias' | 'undef' | 'BEGIN' | 'END' ;
"""

# -- lexers ---------------------------------------------------------------------
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|(?:\d[\d_]*\.(?![.\w])|\d[\d_]*\.\d[\d_]*|\.\d[\d_]*|\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[A-Za-z_]?\w*"
_ID = r"[^\W\d][\w]*"
_DQ = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'
_SQ = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_SLASH = r"//[^\n]*|/\*[\s\S]*?\*/"


class Lexer:
    """Names the tokens of a text. ``skip`` names nothing: space and comments."""

    def __init__(self, grammar: Grammar, pattern: str, ident: str = "ID", classes: dict[str, str] | None = None, comment: str = "/", prefix: str = r"[ \t\r\f\v]*", wide: bool = False):
        self.grammar, self.ident, self.comment = grammar, ident, comment
        self.classes = classes or {}
        self.wide = wide  # whether space beyond ASCII is space
        self.findall = re.compile(f"{prefix}({pattern}|\\n|[\\s\\S])").findall
        self.table: dict[str, object] = {}

    def name(self, tok: str) -> object:
        """The kind of a token; a tuple for two in one, "" for nothing."""
        c = tok[0]
        if c.isspace() and (self.wide or c.isascii()):
            kind: object = "\n" if "\n" in tok else ""
        elif tok in self.grammar.terminals:
            kind = tok
        elif tok in self.classes:
            kind = self.classes[tok]
        else:
            kind = self.other(tok, c)
        if len(self.table) > 100_000:
            self.table.clear()
        if len(tok) < 60:
            self.table[tok] = kind
        return kind

    def other(self, tok: str, c: str) -> object:
        if self.comment == "/" and tok[:2] in ("//", "/*"):
            return "\n" if tok[1] == "*" and "\n" in tok else ""
        if self.comment == "#" and c == "#":
            return ""
        if c.isalpha() or c == "_":
            if tok[-1] in "\"'`#" or "\n" in tok:
                return "STR"
            return self.ident
        if c.isdigit() or c == "." and len(tok) > 1 and tok[1].isdigit():
            return "NUM"
        if len(tok) > 1 and c in "\"'`":
            return "STR"
        return "BAD"

    def tokens(self, text: str):
        get, name = self.table.get, self.name
        for tok in self.findall(text):
            kind = get(tok)
            if kind is None:
                kind = name(tok)
            if kind.__class__ is tuple:
                yield from kind
            elif kind and kind != "\n":
                yield kind


class PythonLexer(Lexer):
    _OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")

    def tokens(self, text: str):
        get, name = self.table.get, self.name
        depth, levels, start, some = 0, [0], "", False
        pending = True
        # a line end in front, so that the first line has an indentation too
        for tok in self.findall("\n" + text if text.endswith("\n") else f"\n{text}\n"):
            if tok[0] == "\n":
                if not depth:
                    if some:
                        yield "NEWLINE"
                        some = False
                    pending, start = True, tok[tok.rfind("\n") + 1 :]
                continue
            kind = get(tok)
            if kind is None:
                kind = name(tok)
            if not kind:
                if pending and tok.isspace() and not some:
                    start += tok
                continue
            if pending:
                pending = False
                width = len(start.replace("\f", "").expandtabs(8))
                if width > levels[-1]:
                    levels.append(width)
                    yield "INDENT"
                else:
                    while width < levels[-1]:
                        levels.pop()
                        yield "DEDENT"
                    if width != levels[-1]:
                        yield "BAD"
            some = True
            if kind in self._OPEN:
                depth += 1
            elif kind in self._CLOSE:
                depth -= 1
            yield kind
        if some:
            yield "NEWLINE"
        for _ in levels[1:]:
            yield "DEDENT"

    def other(self, tok, c):
        return "" if tok.startswith("\\\n") or tok.startswith("\\\r") else super().other(tok, c)


class GoLexer(Lexer):
    """Puts the semicolons that line ends stand for."""

    _ENDS = frozenset(["ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])

    def tokens(self, text: str):
        get, name, last = self.table.get, self.name, ""
        for tok in self.findall(text):
            kind = get(tok)
            if kind is None:
                kind = name(tok)
            if kind == "\n":
                if last in self._ENDS:
                    last = ";"
                    yield ";"
            elif kind:
                last = kind
                yield kind
        if last in self._ENDS:
            yield ";"


class LineLexer(Lexer):
    """Keeps line ends as they are, for languages where they matter here and there."""

    def tokens(self, text: str):
        get, name = self.table.get, self.name
        for tok in self.findall(text):
            kind = get(tok)
            if kind is None:
                kind = name(tok)
            if kind.__class__ is tuple:
                yield from kind
            elif kind:
                yield kind

    def other(self, tok, c):
        if len(tok) > 1 and "/" in tok[1:] and c not in "\"'`/" and not c.isalnum():  # operator and regular expression
            head = self.name(c)
            return (head, "RX") if isinstance(head, str) and head else ("RX",)
        if tok.startswith("return") and "/" in tok:
            return ("return", "RX")
        if c == "$":
            return self.ident
        if c == "#" and len(tok) > 1:
            return "PRIVATE"
        return super().other(tok, c)


class RubyLexer(Lexer):
    """Drops line ends after operators and before a leading dot; inside round and square brackets the grammar allows them."""

    _GOES_ON = frozenset(["NL", ".", "&.", ",", "=", "AUG", "BIN", "+", "-", "*", "&", "|", "(", "[", "and", "or", "not", "=>", "?", "::", "<<", "**", "&&", "||"])

    def tokens(self, text: str):
        cut = re.search(r"(?m)^__END__\r?$", text)
        if cut:
            text = text[: cut.start()]
        text = re.sub(r"(?ms)^=begin\b.*?^=end\b[^\n]*", "", text)
        text = _HEREDOC.sub(lambda m: "''" + m[3] + "\n" * m[0].count("\n"), text)
        get, name, last, bars = self.table.get, self.name, "NL", ""
        held = False
        for tok in self.findall(text):
            kind = get(tok)
            if kind is None:
                kind = name(tok)
            if kind == "\n":
                held = held or last not in self._GOES_ON or last == "|" and bars == "in"
                continue
            if not kind:
                continue
            if held:
                held = False
                if kind not in (".", "&."):
                    last = "NL"
                    yield "NL"
            if kind == "|":
                bars = "in" if bars == "open" else "open" if last in ("{", "do") else ""
            else:
                bars = bars if bars == "open" else ""
            for kind in kind if kind.__class__ is tuple else (kind,):
                last = kind
                yield kind
        if last != "NL":
            yield "NL"

    def other(self, tok, c):
        if c == ":" and len(tok) > 1:
            return "SYM"
        if tok[-1] == ":" and (c.isalpha() or c in "_\"'"):
            return "LABEL"
        if c in "@$":
            return "ID"
        if c == "%" and len(tok) > 2:
            return "STR"
        m = _RUBY_RX.match(tok) if len(tok) > 2 and "/" in tok else None
        if m:
            head = self.name(m[1].strip()) if m[1] else ""
            return (head, "RX") if head else ("RX",)
        if c.isalpha() and c.isupper() and "'" not in tok:
            return "CONST"
        return super().other(tok, c)


_RUBY_RX = re.compile(r"(=~|!~|[=(,\[!&|?{;+*<>~]|[a-z]+[ \t]+)?[ \t]*/", re.S)
_HEREDOC = re.compile(r"<<[~-]?(['\"]?)([A-Z_]\w*)\1([^\n]*)\n(?:[^\n]*\n)*?[ \t]*\2(?=\r?\n|\r?$)")
_RX = r"/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"


def _ops(*ops: str) -> str:
    return "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))


def _kinds(**classes: str) -> dict[str, str]:
    return {tok: kind for kind, toks in classes.items() for tok in toks.split()}


def _python() -> Lexer:
    strings = r"(?:[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|" + _DQ + "|" + _SQ + ")"
    aug = "+= -= *= /= //= %= @= &= |= ^= >>= <<= **="
    binary = "// % << >> & ^ < > == >= <= !="
    ops = _ops(*aug.split(), *binary.split(), "**", "*", "/", "+", "-", "@", "|", "~", "->", ":=", "...", *"()[]{},:;.=")
    return PythonLexer(Grammar(PYTHON), r"\n(?:[ \t\f]*\r?\n)*[ \t\f]*|#[^\n]*|\\\r?\n|" + strings + "|" + _NUM + "|" + _ID + "|" + ops, classes=_kinds(AUG=aug, BIN=binary), comment="#", prefix=r"[ \t\r\f]*")


def _js(ts: bool) -> Lexer:
    binary = "/ % ** == != === !== <= << && || ?? += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= ^"
    pre = "~" if ts else "! ~ typeof void delete"
    ops = _ops(*binary.split(), "=>", "?.", "...", ">=", *"()[]{},:;.=<>+-*&|?!~@", "++", "--")
    classes = _kinds(BIN=binary, PRE=pre + " delete")
    text = _javascript(ts)
    template = r"`(?:\\[\s\S]|\$\{(?:[^{}`]|`(?:\\[\s\S]|[^`\\])*`|\{[^{}]*\})*\}|[^`\\$]|\$(?!\{))*`"
    ident = r"[^\W\d][\w$]*|\$[\w$]*"
    return LineLexer(Grammar(text), _SLASH + "|" + r"(?:[=(,:\[!&|?{};+*%<>~^-]|\breturn)[ \t\r\n]*" + _RX + "|" + _DQ + "|" + _SQ + "|" + template + "|#" + _ID + "|" + _NUM + "|" + ident + "|" + r"\?\.(?!\d)|" + ops, classes=classes, wide=True)


def _c_like(grammar: str, binary: str, pre: str, post: str = "", extra: str = "", ops: tuple = (), prim: str = "", strings: str = "", cls=Lexer, classes: dict | None = None, slash: str = _SLASH, wide: bool = False) -> Lexer:
    pattern = slash + "|" + (strings + "|" if strings else "") + _DQ + "|" + _SQ + "|" + _NUM + "|" + (extra + "|" if extra else "") + r"@?" + _ID + "|" + _ops(*binary.split(), *pre.split(), *ops, *"()[]{},:;.=<>+-*&|?!~@^#")
    kinds = _kinds(BIN=binary, PRE=pre, POST=post, PRIM=prim) | (classes or {})
    return cls(Grammar(grammar), pattern, classes=kinds, wide=wide)


_AUG = "+= -= *= /= %= &= |= ^= <<="


def _java() -> Lexer:
    lexer = _c_like(_JAVA.replace("(PRE |", "(PRE | POST |"), f"/ % == != <= << && || ^ {_AUG}", "! ~", "++ --", ops=("->", "::", "...", "++", "--", ">="), prim="int long short byte char float double boolean var", strings=r'"""[\s\S]*?"""')
    lexer.findall = re.compile(lexer.findall.__self__.pattern.replace("@?" + _ID, _ID)).findall
    return lexer


class CSharpLexer(Lexer):
    def other(self, tok, c):
        if c in "$@" and '"' in tok:
            return "STR"
        if c == "@" and len(tok) > 1:
            return "ID"
        if c == "#":
            return ""
        return super().other(tok, c)


def _csharp() -> Lexer:
    strings = r'"""[\s\S]*?"""|\$?@\$?"(?:[^"]|"")*"|\$"(?:[^"\\{\n]|\\.|\{\{|\{(?:[^{}"\n]|"(?:[^"\\\n]|\\.)*")*\})*"'
    return _c_like(_CSHARP, f"/ % == != <= << && || {_AUG} ??=", "", ops=("->", "::", "=>", "++", "--", ">=", "??", ".."), prim="int long short byte char float double bool string object decimal uint ulong ushort sbyte nint nuint dynamic", strings=strings, cls=CSharpLexer, wide=True, extra=r"(?<=\n)#[^\n]*")


def _go() -> Lexer:
    aug = f"{_AUG} >>= &^="
    return _c_like(_GO, "/ % << >> &^ == != < <= > >= && ||", "!", ops=(*aug.split(), "<-", ":=", "...", "++", "--"), strings=r"`[^`]*`", cls=GoLexer, classes=_kinds(AUG=aug))


class RustLexer(Lexer):
    """Inside macros and attributes any token may stand; all others also count as ANY there."""

    def other(self, tok, c):
        if c == "'" and tok[-1] != "'" or c == "'" and len(tok) == 1:
            return "LIFE" if len(tok) > 1 else "BAD"
        return super().other(tok, c)


def _rust() -> Lexer:
    words = "as async await box break const continue crate default dyn else enum extern false fn for if impl in let loop match mod move mut pub raw ref return self static struct super trait true type union unsafe use where while yield".split()
    marks = "! # & * + , - -> . .. ... ..= / : :: ; < = => > >= ? @ _ | || ~ $ ^".split()
    every = [f"'{w}'" for w in [*words, *marks] if w not in ("/", "~", "$", "^")] + ["ID", "NUM", "STR", "LIFE", "BIN", "MARK"]
    grammar = re.sub(r"\bANY\b", " | ".join(every), _RUST)
    strings = r'b?r###"[\s\S]*?"###|b?r##"[\s\S]*?"##|b?r#"[\s\S]*?"#|b?r"[^"]*"|[bc]?"(?:[^"\\]|\\[\s\S])*"' + r"|b?'(?:[^'\\\n]|\\(?:x..|u\{[^}]*\}|.))'|'" + _ID
    lexer = _c_like(grammar, f"/ % == != <= << && ^ {_AUG}", "", ops=("->", "::", "=>", ">=", "..", "...", "..=", "||", "$"), strings=strings, cls=RustLexer, classes={"~": "MARK", "$": "MARK"}, slash=r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/")
    lexer.findall = re.compile(lexer.findall.__self__.pattern.replace("@?" + _ID, "(?:r#)?" + _ID)).findall
    return lexer


def _ruby() -> Lexer:
    binary = "/ % == != === =~ !~ <= >= <=> && || >> ^"
    aug = "+= -= *= /= %= **= ||= &&= |= &= ^= <<= >>="
    ops = _ops(*binary.split(), *aug.split(), "**", "<<", "=>", "->", "::", "&.", "..", "...", "||", *"()[]{},:;.=<>+-*&|?!~")
    words = "|".join([_DQ[:-1].replace("\\n\\r", "") + '"', r"'(?:[^'\\]|\\[\s\S])*'"])
    pattern = (
        r"#[^\n]*|(?:" + words + r")(?::(?!:))?|`[^`]*`|" + r"%[wWiIqQrx]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|![^!]*!|\|[^|]*\|)"
        r"|:(?:" + _ID + r"[?!=]?(?![=>~])|\"[^\"]*\"|\[\]=?|<=>|===?|[+\-*/<>!%])|(?:=~|!~|[=(,\[!&|?{;+*<>~]|\b(?:if|elsif|unless|when|and|or|not|return|while|until)[ \t]+|(?<=\n))[ \t]*" + _RX + "|" + _NUM + r"|\?[A-Za-z](?!\w)|@@?" + _ID + r"|\$[\w~!@&`'+*?;:./\\<>_-]+"
        r"|" + _ID + r"[?!](?!=(?!=))(?::(?!:))?|" + _ID + r":(?![:])|defined\?|" + _ID + "|" + ops
    )
    return RubyLexer(Grammar(_RUBY), pattern, classes=_kinds(BIN=binary, AUG=aug), comment="#", prefix=r"(?:[ \t\r\f]|\\\r?\n)*")


LEXERS = {"python": _python, "javascript": lambda: _js(False), "typescript": lambda: _js(True), "java": _java, "csharp": _csharp, "go": _go, "rust": _rust, "ruby": _ruby}
#: Languages in which a line end or a closing brace may stand for a missing semicolon.
OPTIONAL_SEMICOLONS = frozenset(["javascript", "typescript"])

_ready: dict[str, Lexer] = {}


def lexer(language: str) -> Lexer | None:
    """The lexer of a language with its grammar, built once a process; None for an unknown one."""
    if language not in _ready and language in LEXERS:
        _ready[language] = LEXERS[language]()
    return _ready.get(language)


def check(text: str, language: str):
    """None if ``text`` is a valid file of ``language`` (or the language is unknown, or the text holds no token), else (index of the failing token, its kind), with kind ``end`` if the text stops too early."""
    lex = lexer(language)
    if lex is None:
        return None
    g = lex.grammar
    state, empty, derive = g.fresh(), g.empty, g.derive
    if text.startswith("\ufeff"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    k, kind = -1, ""
    if language in OPTIONAL_SEMICOLONS:
        broken = False
        for kind in lex.tokens(text):
            if kind == "\n":
                broken = True
                continue
            k += 1
            after = state.d.get(kind)
            if after is None:
                after = derive(state, kind)
            if after is empty:
                if broken or kind == "}":
                    after = derive(derive(state, ";"), kind)
                if after is empty:
                    return k, kind
            state, broken = after, False
        return None if k < 0 or state.null or derive(state, ";").null else (k + 1, "end")
    for kind in lex.tokens(text):
        k += 1
        after = state.d.get(kind)
        if after is None:
            after = derive(state, kind)
        if after is empty:
            return k, kind
        state = after
    return None if k < 0 or state.null else (k + 1, "end")
