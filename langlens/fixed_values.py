"""Fixed values that the results depend on: lists, lookup tables and patterns, as text."""

# Extensions that several languages share, with their candidates in tie order.
SHARED_EXTENSIONS = {
    '.1': ['Roff Manpage', 'Roff'],
    '.1in': ['Roff Manpage', 'Roff'],
    '.1m': ['Roff Manpage', 'Roff'],
    '.1x': ['Roff Manpage', 'Roff'],
    '.2': ['Roff Manpage', 'Roff'],
    '.3': ['Roff Manpage', 'Roff'],
    '.3in': ['Roff Manpage', 'Roff'],
    '.3m': ['Roff Manpage', 'Roff'],
    '.3p': ['Roff Manpage', 'Roff'],
    '.3pm': ['Roff Manpage', 'Roff'],
    '.3qt': ['Roff Manpage', 'Roff'],
    '.3x': ['Roff Manpage', 'Roff'],
    '.4': ['Roff Manpage', 'Roff'],
    '.5': ['Roff Manpage', 'Roff'],
    '.6': ['Roff Manpage', 'Roff'],
    '.7': ['Roff Manpage', 'Roff'],
    '.8': ['Roff Manpage', 'Roff'],
    '.9': ['Roff Manpage', 'Roff'],
    '.as': ['AngelScript', 'ActionScript'],
    '.asc': ['AGS Script', 'AsciiDoc', 'Public Key'],
    '.asm': ['Motorola 68K Assembly', 'Assembly'],
    '.asy': ['LTspice Symbol', 'Asymptote'],
    '.b': ['Brainfuck', 'Limbo'],
    '.bb': ['BitBake', 'BlitzBasic'],
    '.bf': ['Brainfuck', 'HyPhy'],
    '.brd': ['Eagle', 'KiCad Legacy Layout'],
    '.cake': ['C#', 'CoffeeScript'],
    '.cfg': ['INI', 'HAProxy'],
    '.cgi': ['Python', 'Perl', 'Shell'],
    '.ch': ['xBase', 'Charity'],
    '.cl': ['OpenCL', 'Cool', 'Common Lisp'],
    '.cls': ['Apex', 'VBA', 'TeX', 'OpenEdge ABL', 'ObjectScript'],
    '.cp': ['C++', 'Component Pascal'],
    '.cs': ['C#', 'Smalltalk'],
    '.d': ['Makefile', 'DTrace', 'D'],
    '.ddl': ['PLSQL', 'SQL'],
    '.dsp': ['Faust', 'Microsoft Developer Studio Project'],
    '.e': ['Eiffel', 'E'],
    '.ecl': ['ECLiPSe', 'ECL'],
    '.es': ['JavaScript', 'Erlang'],
    '.f': ['Fortran', 'Forth', 'Filebench WML'],
    '.fcgi': ['Python', 'PHP', 'Perl', 'Lua', 'Ruby', 'Shell'],
    '.for': ['Fortran', 'Forth', 'Formatted'],
    '.fr': ['Text', 'Forth', 'Frege'],
    '.frag': ['JavaScript', 'GLSL'],
    '.fs': ['F#', 'Forth', 'Filterscript', 'GLSL'],
    '.fx': ['FLUX', 'HLSL'],
    '.g': ['G-code', 'GAP'],
    '.gd': ['GAP', 'GDScript'],
    '.gml': ['Game Maker Language', 'Gerber Image', 'Graph Modeling Language', 'XML'],
    '.gs': ['Genie', 'Gosu', 'JavaScript', 'GLSL'],
    '.h': ['C++', 'Objective-C', 'C'],
    '.hh': ['C++', 'Hack'],
    '.i': ['Motorola 68K Assembly', 'Assembly', 'SWIG'],
    '.ice': ['Slice', 'JSON'],
    '.inc': ['Motorola 68K Assembly', 'C++', 'SQL', 'Assembly', 'PHP', 'SourcePawn', 'POV-Ray SDL', 'Pascal', 'Pawn', 'NASL', 'HTML'],
    '.j': ['Jasmin', 'Objective-J'],
    '.l': ['Common Lisp', 'Roff', 'PicoLisp', 'Lex'],
    '.lisp': ['NewLisp', 'Common Lisp'],
    '.ls': ['LoomScript', 'LiveScript'],
    '.lsp': ['NewLisp', 'Common Lisp'],
    '.m': ['MATLAB', 'Mathematica', 'Mercury', 'Objective-C', 'Limbo', 'M', 'MUF'],
    '.m4': ['M4', 'M4Sugar'],
    '.man': ['Roff Manpage', 'Roff'],
    '.mask': ['Mask', 'Unity3D Asset'],
    '.md': ['Markdown', 'GCC Machine Description'],
    '.mdoc': ['Roff Manpage', 'Roff'],
    '.ml': ['Standard ML', 'OCaml'],
    '.mm': ['Objective-C++', 'XML'],
    '.mod': ['AMPL', 'Modula-2', 'Linux Kernel Module', 'XML'],
    '.moo': ['Mercury', 'Moocode'],
    '.mqh': ['MQL5', 'MQL4'],
    '.ms': ['Unix Assembly', 'MAXScript', 'Roff'],
    '.n': ['Nemerle', 'Roff'],
    '.nb': ['Text', 'Mathematica'],
    '.ncl': ['Text', 'NCL', 'XML'],
    '.nl': ['NewLisp', 'NL'],
    '.odin': ['Object Data Instance Notation', 'Odin'],
    '.p': ['OpenEdge ABL', 'Gnuplot'],
    '.php': ['PHP', 'Hack'],
    '.pl': ['Raku', 'Perl', 'Prolog'],
    '.plist': ['XML Property List', 'OpenStep Property List'],
    '.pluginspec': ['XML', 'Ruby'],
    '.pm': ['Raku', 'Perl', 'X PixMap'],
    '.pod': ['Pod 6', 'Pod'],
    '.pp': ['Pascal', 'Puppet'],
    '.prc': ['PLSQL', 'SQL'],
    '.pro': ['INI', 'IDL', 'QMake', 'Proguard', 'Prolog'],
    '.properties': ['INI', 'Java Properties'],
    '.q': ['q', 'HiveQL'],
    '.r': ['R', 'Rebol'],
    '.re': ['C++', 'Reason'],
    '.rno': ['Roff', 'RUNOFF'],
    '.rpy': ["Ren'Py", 'Python'],
    '.rs': ['RenderScript', 'Rust'],
    '.s': ['Motorola 68K Assembly', 'Unix Assembly'],
    '.sc': ['SuperCollider', 'Scala'],
    '.sch': ['Scheme', 'KiCad Schematic', 'Eagle', 'XML'],
    '.shader': ['ShaderLab', 'GLSL'],
    '.sls': ['Scheme', 'SaltStack'],
    '.spec': ['Python', 'RPM Spec', 'Ruby'],
    '.sql': ['PLSQL', 'SQL', 'TSQL', 'PLpgSQL', 'SQLPL'],
    '.srt': ['SRecode Template', 'SubRip Text'],
    '.st': ['Smalltalk', 'HTML'],
    '.t': ['Turing', 'Raku', 'Terra', 'Perl'],
    '.toc': ['TeX', 'World of Warcraft Addon Data'],
    '.ts': ['TypeScript', 'XML'],
    '.tst': ['GAP', 'Scilab'],
    '.tsx': ['TSX', 'XML'],
    '.v': ['V', 'Verilog', 'Coq'],
    '.vba': ['VBA', 'Vim script'],
    '.vhost': ['Nginx', 'ApacheConf'],
    '.w': ['CWeb', 'OpenEdge ABL'],
    '.workflow': ['HCL', 'XML'],
    '.x': ['DirectX 3D File', 'Logos', 'RPC', 'Linker Script'],
    '.yy': ['JSON', 'Yacc'],
}

# Interpreters and their languages, in tie order.
INTERPRETERS = {
    'Rscript': ['R'],
    'apl': ['APL'],
    'aplx': ['APL'],
    'ash': ['Shell'],
    'asy': ['Asymptote'],
    'awk': ['Awk'],
    'bash': ['Shell'],
    'bigloo': ['Scheme'],
    'boolector': ['SMT'],
    'ccl': ['Common Lisp'],
    'chakra': ['JavaScript'],
    'chicken': ['Scheme'],
    'clisp': ['Common Lisp'],
    'coffee': ['CoffeeScript'],
    'cperl': ['Perl'],
    'crystal': ['Crystal'],
    'csh': ['Tcsh'],
    'csi': ['Scheme'],
    'cvc4': ['SMT'],
    'cwl-runner': ['Common Workflow Language'],
    'd8': ['JavaScript'],
    'dart': ['Dart'],
    'dash': ['Shell'],
    'deno': ['TypeScript'],
    'dtrace': ['DTrace'],
    'dyalog': ['APL'],
    'ecl': ['Common Lisp'],
    'elixir': ['Elixir'],
    'escript': ['Erlang'],
    'fish': ['fish'],
    'gawk': ['Awk'],
    'gerbv': ['Gerber Image'],
    'gerbview': ['Gerber Image'],
    'gjs': ['JavaScript'],
    'gn': ['GN'],
    'gnuplot': ['Gnuplot'],
    'gosh': ['Scheme'],
    'groovy': ['Groovy'],
    'gsed': ['sed'],
    'guile': ['Scheme'],
    'hy': ['Hy'],
    'instantfpc': ['Pascal'],
    'io': ['Io'],
    'ioke': ['Ioke'],
    'jconsole': ['J'],
    'jolie': ['Jolie'],
    'jruby': ['Ruby'],
    'js': ['JavaScript'],
    'julia': ['Julia'],
    'ksh': ['Shell'],
    'lisp': ['Common Lisp'],
    'lsl': ['LSL'],
    'lua': ['Terra', 'Lua'],
    'macruby': ['Ruby'],
    'make': ['Makefile'],
    'makeinfo': ['Texinfo'],
    'mathsat5': ['SMT'],
    'mawk': ['Awk'],
    'minised': ['sed'],
    'mksh': ['Shell'],
    'mmi': ['Mercury'],
    'moon': ['MoonScript'],
    'nawk': ['Awk'],
    'newlisp': ['NewLisp'],
    'nextflow': ['Nextflow'],
    'node': ['JavaScript'],
    'nush': ['Nu'],
    'ocaml': ['Reason', 'OCaml'],
    'ocamlrun': ['OCaml'],
    'ocamlscript': ['OCaml'],
    'openrc-run': ['OpenRC runscript'],
    'opensmt': ['SMT'],
    'osascript': ['AppleScript'],
    'parrot': ['Parrot Internal Representation', 'Parrot Assembly'],
    'pdksh': ['Shell'],
    'perl': ['Pod', 'Perl'],
    'perl6': ['Pod 6', 'Raku'],
    'php': ['PHP'],
    'picolisp': ['PicoLisp'],
    'pike': ['Pike'],
    'pil': ['PicoLisp'],
    'pwsh': ['PowerShell'],
    'python': ['Python'],
    'python2': ['Python'],
    'python3': ['Python'],
    'qjs': ['JavaScript'],
    'qmake': ['QMake'],
    'r6rs': ['Scheme'],
    'racket': ['Racket'],
    'rake': ['Ruby'],
    'raku': ['Raku'],
    'rakudo': ['Raku'],
    'rbx': ['Ruby'],
    'rc': ['Shell'],
    'regina': ['REXX'],
    'rexx': ['REXX'],
    'rhino': ['JavaScript'],
    'ruby': ['Ruby'],
    'rune': ['E'],
    'runhaskell': ['Haskell'],
    'sbcl': ['Common Lisp'],
    'scala': ['Scala'],
    'scheme': ['Scheme'],
    'sclang': ['SuperCollider'],
    'scsynth': ['SuperCollider'],
    'sed': ['sed'],
    'sh': ['Shell'],
    'smt-rat': ['SMT'],
    'smtinterpol': ['SMT'],
    'ssed': ['sed'],
    'stp': ['SMT'],
    'swipl': ['Prolog'],
    'tcc': ['C'],
    'tclsh': ['Tcl'],
    'tcsh': ['Tcsh'],
    'ts-node': ['TypeScript'],
    'v8': ['JavaScript'],
    'v8-shell': ['JavaScript'],
    'verit': ['SMT'],
    'wish': ['Tcl'],
    'yap': ['Prolog'],
    'yices2': ['SMT'],
    'z3': ['SMT'],
    'zsh': ['Shell'],
}

# Rules that tell languages of a shared extension apart, in order: (languages, condition).
# A condition is None (always), a pattern, ('named', name), ('not', pattern), ('any', ...) or ('all', ...).
RULES = [
    (['.1', '.1in', '.1m', '.1x', '.2', '.3', '.3in', '.3m', '.3p', '.3pm', '.3qt', '.3x', '.4', '.5', '.6', '.7', '.8', '.9', '.man', '.mdoc'], [
        (['Roff Manpage'], ('all', '^[.\'][ \\t]*Dd +(?:[^"\\s]+|"[^"]+")', '^[.\'][ \\t]*Dt +(?:[^"\\s]+|"[^"]+") +"?(?:[1-9]|@[^\\s@]+@)', '^[.\'][ \\t]*Sh +(?:[^"\\s]|"[^"]+")')),
        (['Roff Manpage'], ('all', '^[.\'][ \\t]*TH +(?:[^"\\s]+|"[^"]+") +"?(?:[1-9]|@[^\\s@]+@)', '^[.\'][ \\t]*SH +(?:[^"\\s]+|"[^"\\s]+)')),
        (['Roff'], None),
    ]),
    (['.as'], [
        (['ActionScript'], '^\\s*(package\\s+[a-z0-9_\\.]+|import\\s+[a-zA-Z0-9_\\.]+;|class\\s+[A-Za-z0-9_]+\\s+extends\\s+[A-Za-z0-9_]+)'),
        (['AngelScript'], None),
    ]),
    (['.asc'], [
        (['Public Key'], '^(----[- ]BEGIN|ssh-(rsa|dss)) '),
        (['AsciiDoc'], '^[=-]+(\\s|\\n)|{{[A-Za-z]'),
        (['AGS Script'], '^(\\/\\/.+|((import|export)\\s+)?(function|int|float|char)\\s+((room|repeatedly|on|game)_)?([A-Za-z]+[A-Za-z_0-9]+)\\s*[;\\(])'),
    ]),
    (['.asm'], [
        (['Motorola 68K Assembly'], ('named', 'm68k')),
    ]),
    (['.asy'], [
        (['LTspice Symbol'], '^SymbolType[ \\t]'),
        (['Asymptote'], None),
    ]),
    (['.bb'], [
        (['BlitzBasic'], '(<^\\s*; |End Function)'),
        (['BitBake'], '^\\s*(# |include|require)\\b'),
    ]),
    (['.builds'], [
        (['XML'], '^(\\s*)(?i:<Project|<Import|<Property|<?xml|xmlns)'),
        (['Text'], None),
    ]),
    (['.ch'], [
        (['xBase'], '^\\s*#\\s*(?i:if|ifdef|ifndef|define|command|xcommand|translate|xtranslate|include|pragma|undef)\\b'),
    ]),
    (['.cl'], [
        (['Common Lisp'], '^\\s*\\((?i:defun|in-package|defpackage) '),
        (['Cool'], '^class'),
        (['OpenCL'], '\\/\\* |\\/\\/ |^\\}'),
    ]),
    (['.cls'], [
        (['TeX'], '\\\\\\w+{'),
        (['ObjectScript'], '^Class\\s'),
    ]),
    (['.cs'], [
        (['Smalltalk'], '![\\w\\s]+methodsFor: '),
        (['C#'], '^(\\s*namespace\\s*[\\w\\.]+\\s*{|\\s*\\/\\/)'),
    ]),
    (['.d'], [
        (['D'], '^module\\s+[\\w.]*\\s*;|import\\s+[\\w\\s,.:]*;|\\w+\\s+\\w+\\s*\\(.*\\)(?:\\(.*\\))?\\s*{[^}]*}|unittest\\s*(?:\\(.*\\))?\\s*{[^}]*}'),
        (['DTrace'], '^(\\w+:\\w*:\\w*:\\w*|BEGIN|END|provider\\s+|(tick|profile)-\\w+\\s+{[^}]*}|#pragma\\s+D\\s+(option|attributes|depends_on)\\s|#pragma\\s+ident\\s)'),
        (['Makefile'], '([\\/\\\\].*:\\s+.*\\s\\\\$|: \\\\$|^[ %]:|^[\\w\\s\\/\\\\.]+\\w+\\.\\w+\\s*:\\s+[\\w\\s\\/\\\\.]+\\w+\\.\\w+)'),
    ]),
    (['.dsp'], [
        (['Microsoft Developer Studio Project'], '# Microsoft Developer Studio Generated Build File'),
        (['Faust'], '\\bprocess\\s*[(=]|\\b(library|import)\\s*\\(\\s*"|\\bdeclare\\s+(name|version|author|copyright|license)\\s+"'),
    ]),
    (['.ecl'], [
        (['ECLiPSe'], '^[^#]+:-'),
        (['ECL'], ':='),
    ]),
    (['.es'], [
        (['Erlang'], '^\\s*(?:%%|main\\s*\\(.*?\\)\\s*->)'),
        (['JavaScript'], '(?m:\\/\\/|("|\')use strict\\1|export\\s+default\\s|\\/\\*.*?\\*\\/)'),
    ]),
    (['.f'], [
        (['Forth'], '^: '),
        (['Filebench WML'], 'flowop'),
        (['Fortran'], ('named', 'fortran')),
    ]),
    (['.for'], [
        (['Forth'], '^: '),
        (['Fortran'], ('named', 'fortran')),
    ]),
    (['.fr'], [
        (['Forth'], '^(: |also |new-device|previous )'),
        (['Frege'], '^\\s*(import|module|package|data|type) '),
        (['Text'], None),
    ]),
    (['.fs'], [
        (['Forth'], '^(: |new-device)'),
        (['F#'], '^\\s*(#light|import|let|module|namespace|open|type)'),
        (['GLSL'], '^\\s*(#version|precision|uniform|varying|vec[234])'),
        (['Filterscript'], '#include|#pragma\\s+(rs|version)|__attribute__'),
    ]),
    (['.gd'], [
        (['GAP'], '\\s*(Declare|BindGlobal|KeyDependentOperation)'),
        (['GDScript'], '\\s*(extends|var|const|enum|func|class|signal|tool|yield|assert|onready)'),
    ]),
    (['.gml'], [
        (['XML'], '(?i:^\\s*(\\<\\?xml|xmlns))'),
        (['Graph Modeling Language'], '(?i:^\\s*(graph|node)\\s+\\[$)'),
        (['Gerber Image'], '\\*\\%$'),
        (['Game Maker Language'], None),
    ]),
    (['.gs'], [
        (['GLSL'], '^#version\\s+[0-9]+\\b'),
        (['Gosu'], '^uses java\\.'),
    ]),
    (['.h'], [
        (['Objective-C'], ('named', 'objectivec')),
        (['C++'], ('named', 'cpp')),
        (['C'], None),
    ]),
    (['.hh'], [
        (['Hack'], '<\\?hh'),
    ]),
    (['.i'], [
        (['Motorola 68K Assembly'], ('named', 'm68k')),
        (['SWIG'], '^[ \\t]*%[a-z_]+\\b|^%[{}]$'),
    ]),
    (['.ice'], [
        (['JSON'], '\\A\\s*[{\\[]'),
        (['Slice'], None),
    ]),
    (['.inc'], [
        (['Motorola 68K Assembly'], ('named', 'm68k')),
        (['PHP'], '^<\\?(?:php)?'),
        (['SourcePawn'], '^public\\s+(?:SharedPlugin(?:\\s+|:)__pl_\\w+\\s*=(?:\\s*{)?|(?:void\\s+)?__pl_\\w+_SetNTVOptional\\(\\)(?:\\s*{)?)'),
        (['NASL'], ('any', '^\\s*include\\s*\\(\\s*(?:"|\')[\\\\/\\w\\-\\.:\\s]+\\.(?:nasl|inc)\\s*(?:"|\')\\s*\\)\\s*;', '^\\s*(?:global|local)_var\\s+(?:\\w+(?:\\s*=\\s*[\\w\\-"\']+)?\\s*)(?:,\\s*\\w+(?:\\s*=\\s*[\\w\\-"\']+)?\\s*)*+\\s*;', '^\\s*namespace\\s+\\w+\\s*{', '^\\s*object\\s+\\w+\\s*(?:extends\\s+\\w+(?:::\\w+)?)?\\s*{', '^\\s*(?:public\\s+|private\\s+|\\s*)function\\s+\\w+\\s*\\([\\w\\s,]*\\)\\s*{')),
        (['POV-Ray SDL'], '^\\s*#(declare|local|macro|while)\\s'),
    ]),
    (['.l'], [
        (['Common Lisp'], '\\(def(un|macro)\\s'),
        (['Lex'], '^(%[%{}]xs|<.*>)'),
        (['Roff'], '^\\.[A-Za-z]{2}(\\s|$)'),
        (['PicoLisp'], '^\\((de|class|rel|code|data|must)\\s'),
    ]),
    (['.ls'], [
        (['LoomScript'], '^\\s*package\\s*[\\w\\.\\/\\*\\s]*\\s*{'),
        (['LiveScript'], None),
    ]),
    (['.lsp', '.lisp'], [
        (['Common Lisp'], '^\\s*\\((?i:defun|in-package|defpackage) '),
        (['NewLisp'], '^\\s*\\(define '),
    ]),
    (['.m'], [
        (['Objective-C'], ('named', 'objectivec')),
        (['Mercury'], ':- module'),
        (['MUF'], '^: '),
        (['M'], '^\\s*;'),
        (['Mathematica'], ('all', '\\(\\*', '\\*\\)$')),
        (['MATLAB'], '^\\s*%'),
        (['Limbo'], '^\\w+\\s*:\\s*module\\s*{'),
    ]),
    (['.mask'], [
        (['Unity3d Asset'], 'tag:unity3d.com'),
    ]),
    (['.md'], [
        (['Markdown'], ('any', '(^[-A-Za-z0-9=#!\\*\\[|>])|<\\/', '\\A\\z')),
        (['GCC Machine Description'], '^(;;|\\(define_)'),
        (['Markdown'], None),
    ]),
    (['.ml'], [
        (['OCaml'], '(^\\s*module)|let rec |match\\s+(\\S+\\s)+with'),
        (['Standard ML'], '=> |case\\s+(\\S+\\s)+of'),
    ]),
    (['.mod'], [
        (['XML'], '<!ENTITY '),
        (['Modula-2'], '^\\s*(?i:MODULE|END) [\\w\\.]+;'),
        (['Linux Kernel Module', 'AMPL'], None),
    ]),
    (['.ms'], [
        (['Roff'], "^[.'][A-Za-z]{2}(\\s|$)"),
        (['Unix Assembly'], ('all', ('not', '/\\*'), '^\\s*\\.(?:include\\s|globa?l\\s|[A-Za-z][_A-Za-z0-9]*:)')),
        (['MAXScript'], None),
    ]),
    (['.n'], [
        (['Roff'], "^[.']"),
        (['Nemerle'], '^(module|namespace|using)\\s'),
    ]),
    (['.ncl'], [
        (['XML'], '^\\s*<\\?xml\\s+version'),
        (['Text'], 'THE_TITLE'),
    ]),
    (['.nl'], [
        (['NL'], '^(b|g)[0-9]+ '),
        (['NewLisp'], None),
    ]),
    (['.odin'], [
        (['Object Data Instance Notation'], '(?:^|<)\\s*[A-Za-z0-9_]+\\s*=\\s*<'),
        (['Odin'], 'package\\s+\\w+|\\b(?:im|ex)port\\s*"[\\w:./]+"|\\w+\\s*::\\s*(?:proc|struct)\\s*\\(|^\\s*//\\s'),
    ]),
    (['.p'], [
        (['Gnuplot'], ('any', '^s?plot\\b', '^set\\s+(term|terminal|out|output|[xy]tics|[xy]label|[xy]range|style)\\b')),
        (['OpenEdge ABL'], None),
    ]),
    (['.php'], [
        (['Hack'], '<\\?hh'),
        (['PHP'], '<\\?[^h]'),
    ]),
    (['.pl'], [
        (['Prolog'], '^[^#]*:-'),
        (['Perl'], ('named', 'perl5')),
        (['Raku'], ('named', 'perl6')),
    ]),
    (['.plist'], [
        (['XML Property List'], '<!DOCTYPE\\s+plist'),
        (['OpenStep Property List'], None),
    ]),
    (['.pm'], [
        (['Perl'], ('named', 'perl5')),
        (['Raku'], ('named', 'perl6')),
        (['X PixMap'], '^\\s*\\/\\* XPM \\*\\/'),
    ]),
    (['.pod'], [
        (['Pod 6'], '^[\\s&&[^\\n]]*=(comment|begin pod|begin para|item\\d+)'),
        (['Pod'], None),
    ]),
    (['.pp'], [
        (['Pascal'], '^\\s*end[.;]'),
        (['Puppet'], '^\\s+\\w+\\s+=>\\s'),
    ]),
    (['.pro'], [
        (['Proguard'], '^-(include\\b.*\\.pro$|keep\\b|keepclassmembers\\b|keepattributes\\b)'),
        (['Prolog'], '^[^\\[#]+:-'),
        (['INI'], 'last_client='),
        (['QMake'], ('all', 'HEADERS', 'SOURCES')),
        (['IDL'], '^\\s*function[ \\w,]+$'),
    ]),
    (['.properties'], [
        (['INI'], ('all', ('named', 'key_equals_value'), '^[;\\[]')),
        (['Java Properties'], ('all', ('named', 'key_equals_value'), '^[#!]')),
        (['INI'], ('named', 'key_equals_value')),
        (['Java properties'], '^[^#!][^:]*:'),
    ]),
    (['.props'], [
        (['XML'], '^(\\s*)(?i:<Project|<Import|<Property|<\\?xml|xmlns)'),
        (['INI'], '(?i:\\w+\\s*=\\s*)'),
    ]),
    (['.q'], [
        (['q'], '((?i:[A-Z.][\\w.]*:{)|(^|\\n)\\\\(cd?|d|l|p|ts?) )'),
        (['HiveQL'], '(?i:SELECT\\s+[\\w*,]+\\s+FROM|(CREATE|ALTER|DROP)\\s(DATABASE|SCHEMA|TABLE))'),
    ]),
    (['.r'], [
        (['Rebol'], '(?i:\\bRebol\\b)'),
        (['R'], '<-|^\\s*#'),
    ]),
    (['.rno'], [
        (['RUNOFF'], '(?i:^\\.!|^\\f|\\f$|^\\.end lit(?:eral)?\\b|^\\.[a-zA-Z].*?;\\.[a-zA-Z](?:[; \\t])|\\^\\*[^\\s*][^*]*\\\\\\*(?=$|\\s)|^\\.c;[ \\t]*\\w+)'),
        (['Roff'], '^\\.\\\\" '),
    ]),
    (['.rpy'], [
        (['Python'], '(?m:^(import|from|class|def)\\s)'),
        (["Ren'Py"], None),
    ]),
    (['.rs'], [
        (['Rust'], '^(use |fn |mod |pub |macro_rules|impl|#!?\\[)'),
        (['RenderScript'], '#include|#pragma\\s+(rs|version)|__attribute__'),
    ]),
    (['.s'], [
        (['Motorola 68K Assembly'], ('named', 'm68k')),
    ]),
    (['.sc'], [
        (['SuperCollider'], '(?i:\\^(this|super)\\.|^\\s*~\\w+\\s*=\\.)'),
        (['Scala'], '(^\\s*import (scala|java)\\.|^\\s*class\\b)'),
    ]),
    (['.sql'], [
        (['PLpgSQL'], "(?i:^\\\\i\\b|AS \\$\\$|LANGUAGE '?plpgsql'?|SECURITY (DEFINER|INVOKER)|BEGIN( WORK )?;)"),
        (['SQLPL'], "(?i:(alter module)|(language sql)|(begin( NOT)+ atomic)|signal SQLSTATE '[0-9]+')"),
        (['PLSQL'], '(?i:\\$\\$PLSQL_|XMLTYPE|sysdate|systimestamp|\\.nextval|connect by|AUTHID (DEFINER|CURRENT_USER)|constructor\\W+function)'),
        (['TSQL'], ('all', ('not', '(?i:IDENTIFIED|NUMBER|VARCHAR2|REPEAT|UNTIL|IMMEDIATE)'), '(?i:(GO)|(@@)|(CREATE PROCEDURE)|BEGIN( TRY| CATCH)|OUTPUT( INSERTED)|IF|ELSE|IIF|CHOOSE|CURSOR|FETCH|DEALLOCATE|DECLARE)')),
        (['SQL'], ('not', '(?i:begin|boolean|package|exception)')),
    ]),
    (['.srt'], [
        (['SubRip Text'], '^(\\d{2}:\\d{2}:\\d{2},\\d{3})\\s*(-->)\\s*(\\d{2}:\\d{2}:\\d{2},\\d{3})$'),
    ]),
    (['.t'], [
        (['Perl'], ('named', 'perl5')),
        (['Raku'], ('named', 'perl6')),
        (['Turing'], '^\\s*%[ \\t]+|^\\s*var\\s+\\w+(\\s*:\\s*\\w+)?\\s*:=\\s*\\w+'),
    ]),
    (['.toc'], [
        (['World of Warcraft Addon Data'], '^## |@no-lib-strip@'),
        (['TeX'], '^\\\\(contentsline|defcounter|beamer|boolfalse)'),
    ]),
    (['.ts'], [
        (['XML'], '<TS\\b'),
        (['TypeScript'], None),
    ]),
    (['.tst'], [
        (['GAP'], 'gap> '),
        (['Scilab'], None),
    ]),
    (['.tsx'], [
        (['TSX'], '^\\s*(import.+(from\\s+|require\\()[\'"]react|\\/\\/\\/\\s*<reference\\s)'),
        (['XML'], '(?i:^\\s*<\\?xml\\s+version)'),
    ]),
    (['.v'], [
        (['Coq'], '\\(\\*.*?\\*\\)|(?:^|\\s)(?:Proof|Qed)\\.(?:$|\\s)|(?:^|\\s)Require[ \\t]+Import\\s'),
        (['Verilog'], '^[ \\t]*module\\s+[^\\s()]+\\s+\\#?\\(|^[ \\t]*`(?:ifdef|timescale)\\s|^[ \\t]*always[ \\t]+@'),
        (['V'], '\\$(?:if|else)[ \\t]|^[ \\t]*fn\\s+[^\\s()]+\\(.*?\\).*?\\{|^[ \\t]*for\\s*\\{'),
    ]),
    (['.vba'], [
        (['Vim script'], '^UseVimball'),
        (['VBA'], None),
    ]),
    (['.w'], [
        (['OpenEdge ABL'], '&ANALYZE-SUSPEND _UIB-CODE-BLOCK _CUSTOM _DEFINITIONS'),
        (['CWeb'], '^@(<|\\w+\\.)'),
    ]),
    (['.x'], [
        (['DirectX 3D File'], '^xof 030(2|3)(?:txt|bin|tzip|bzip)\\b'),
        (['RPC'], '\\b(program|version)\\s+\\w+\\s*{|\\bunion\\s+\\w+\\s+switch\\s*\\('),
        (['Logos'], '^%(end|ctor|hook|group)\\b'),
        (['Linker Script'], 'OUTPUT_ARCH\\(|OUTPUT_FORMAT\\(|SECTIONS'),
    ]),
    (['.yy'], [
        (['JSON'], '\\"modelName\\"\\:\\s*\\"GM'),
        (['Yacc'], None),
    ]),
]

# Patterns that several rules use; a list means any of them.
NAMED = {
    'cpp': ['^\\s*#\\s*include <(cstdint|string|vector|map|list|array|bitset|queue|stack|forward_list|unordered_map|unordered_set|(i|o|io)stream)>', '^\\s*template\\s*<', '^[ \\t]*(try|constexpr)', '^[ \\t]*catch\\s*\\(', '^[ \\t]*(class|(using[ \\t]+)?namespace)\\s+\\w+', '^[ \\t]*(private|public|protected):$', 'std::\\w+'],
    'fortran': '^(?i:[c*][^abd-z]|      (subroutine|program|end|data)\\s|\\s*!)',
    'key_equals_value': '^[^#!;][^=]*=',
    'm68k': ['(?im)\\bmoveq(?:\\.l)?\\s+#(?:\\$-?[0-9a-f]{1,3}|%[0-1]{1,8}|-?[0-9]{1,3}),\\s*d[0-7]\\b', '(?im)^\\s*move(?:\\.[bwl])?\\s+(?:sr|usp),\\s*[^\\s]+', '(?im)^\\s*move\\.[bwl]\\s+.*\\b[ad]\\d', '(?im)^\\s*movem\\.[bwl]\\b', '(?im)^\\s*move[mp](?:\\.[wl])?\\b', '(?im)^\\s*btst\\b', '(?im)^\\s*dbra\\b'],
    'objectivec': '^\\s*(@(interface|class|protocol|property|end|synchronised|selector|implementation)\\b|#import\\s+.+\\.h[">])',
    'perl5': '\\buse\\s+(?:strict\\b|v?5\\.)',
    'perl6': '^\\s*(?:use\\s+v6\\b|\\bmodule\\b|\\b(?:my\\s+)?class\\b)',
}

# Paths that count as documentation.
DOCUMENTATION_GLOBS = [
    '**/[Dd]ocs/**',
    '**/[Dd]oc/**',
    '**/[Dd]ocumentation/**',
    '**/[Gg]roovydoc/**',
    '**/[Jj]avadoc/**',
    '**/[Mm]an/**',
    '**/[Ee]xamples/**',
    '**/[Dd]emo/**',
    '**/[Dd]emos/**',
    '**/inst/doc/**',
    '**/CHANGE*',
    '**/CHANGES*',
    '**/CHANGELOG*',
    '**/CONTRIBUTING*',
    '**/COPYING*',
    '**/INSTALL*',
    '**/LICEN[CS]E*',
    '**/[Ll]icen[cs]e*',
    '**/README*',
    '**/[Rr]eadme*',
    '**/[Ss]ample/**',
    '**/[Ss]amples/**',
]

# Paths that count as vendored.
VENDOR_GLOBS = [
    '**/cache/**',
    '**/[Dd]ependencies/**',
    '**/dist/**',
    '**/deps/**',
    '**/configure',
    '**/config.guess',
    '**/config.sub',
    '**/aclocal.m4',
    '**/libtool.m4',
    '**/ltoptions.m4',
    '**/ltsugar.m4',
    '**/ltversion.m4',
    '**/lt~obsolete.m4',
    '**/dotnet-install.ps1',
    '**/dotnet-install.sh',
    '**/cpplint.py',
    '**/node_modules/**',
    '**/.yarn/releases/**',
    '**/_esy',
    '**/bower_components/**',
    '**/rebar/**',
    '**/erlang.mk',
    '**/Godeps/_workspace/**',
    '**/testdata/**',
    '**/.indent.pro',
    '**/*[.-]min.{css,js}',
    '**/*import.{css,less,scss,styl}',
    '**/bootstrap*.{js,css,less,scss,styl}',
    '**/custom.bootstrap*.{js,css,less,scss,styl}',
    '**/font*awesome.{js,css,less,scss,styl}',
    '**/font*awesome/**/*.{js,css,less,scss,styl}',
    '**/foundation.{css,less,scss,styl}',
    '**/normalize.{css,less,scss,styl}',
    '**/skeleton.{css,less,scss,styl}',
    '**/[Bb]ourbon.{css,less,scss,styl}',
    '**/animate.{css,less,scss,styl}',
    '**/materialize.{css,less,scss,styl,js}',
    '**/select2/*.{css,scss,js}',
    '**/bulma.{css,sass,scss}',
    '**/{3rd,[Tt]hird}*[Pp]arty/**',
    '**/vendor/**',
    '**/vendors/**',
    '**/external/**',
    '**/extern/**',
    '**/[Vv]endor/**',
    '**/debian/**',
    '**/run.n',
    '**/bootstrap-datepicker/**',
    '**/jquery*.{js,css}',
    '**/fuelux.js',
    '**/bootbox.js',
    '**/pdf.worker.js',
    '**/slick.*.js',
    '**/Leaflet.Coordinates*.src.js',
    '**/leaflet.draw-src.js',
    '**/leaflet.draw.css',
    '**/Control.FullScreen.{css,js}',
    '**/leaflet.spin.js',
    '**/wicket-leaflet.js',
    '**/.sublime-project',
    '**/.sublime-workspace',
    '**/.vscode',
    '**/prototype*.js',
    '**/effects.js',
    '**/controls.js',
    '**/dragdrop.js',
    '**/*.d.ts',
    '**/mootools*.js',
    '**/dojo.js',
    '**/MochiKit.js',
    '**/yahoo-*.js',
    '**/yui*.js',
    '**/ckeditor.js',
    '**/tiny_mce*.js',
    '**/tiny_mce/{langs,plugins,themes,utils}/**',
    '**/ace-build/**',
    '**/fontello*.css',
    '**/MathJax/**',
    '**/Chart.js',
    '**/[Cc]ode[Mm]irror/*{lib,mode,theme,addon,keymap,demo}/**',
    '**/shBrush*.js',
    '**/shCore.js',
    '**/shLegacy.js',
    '**/angular*.js',
    '**/d3*.js',
    '**/react*.js',
    '**/flow-typed/*.js',
    '**/modernizr*.js',
    '**/knockout-*.js',
    '**/{doc,docs}/{build,themes,theme,templates,template,static}',
    '**/{doc,docs}/{build,themes,theme,templates,template,static}',
    '**/admin_media/**',
    '**/env/**',
    '**/fabfile.py',
    '**/waf',
    '**/.osx',
    '**/.xctemplate/**',
    '**/.imageset/**',
    '**/Carthage/**',
    '**/Sparkle/**',
    '**/Crashlytics.framework/**',
    '**/Fabric.framework/**',
    '**/BuddyBuildSDK.framework/**',
    '**/Realm.framework',
    '**/RealmSwift.framework',
    '**/.gitattributes',
    '**/.gitignore',
    '**/.gitmodules',
    '**/gradlew',
    '**/gradlew.bat',
    '**/gradle/wrapper/**',
    '**/mvnw',
    '**/mvnw.cmd',
    '**/.mvn/wrapper/**',
    '**/*-vsdoc.js',
    '**/*.intellisense.js',
    '**/jquery*.validate*.js',
    '**/jquery*.unobtrusive-ajax.js.js',
    '**/[Mm]icrosoft{[Aa]jax,[Vv]alidation}*.js',
    '**/[Pp]ackages/*.*/**',
    '**/extjs/*.{js,xml,txt,html,properties}',
    '**/extjs/{.sencha,docs,builds,cmd,examples,locale,packages,plugins,resources,src,welcome}/**',
    '**/html5shiv.js',
    '**/[Tt]es{t,ts}/fixtures/**',
    '**/[Ss]pe{c,cs}/fixtures/**',
    '**/cordova*.js',
    '**/foundation*.js',
    '**/Vagrantfile',
    '**/.[Dd][Ss]_[Ss]tore',
    '**/vignettes/**',
    '**/inst/extdata/**',
    '**/octicons.css',
    '**/sprockets-octicons.scss',
    '**/activiator',
    '**/activator.bat',
    '**/proguard.pro',
    '**/proguard-rules.pro',
    '**/puphet/**',
    '**/.google_apis/**',
    '**/Jenkinsfile',
]

# rules' patterns, and patterns that are found in the same texts but don't try the same text again and again.
# A word is tried from its start alone, blanks and words are not given back, what may reach over line ends reaches over one.
_TARGET = r"[\w \t\x0B\f\/\\.]"
LINEAR = {
    "^module\\s+[\\w.]*\\s*;|import\\s+[\\w\\s,.:]*;|\\w+\\s+\\w+\\s*\\(.*\\)(?:\\(.*\\))?\\s*{[^}]*}|unittest\\s*(?:\\(.*\\))?\\s*{[^}]*}":
        r"^module\s++[\w.]*+\s*+;|import\s[\w\s,.:]*+;|(?<!\w)\w++\s++\w++\s*+\(.*\)\s*+{[^}]*+}|unittest\s*+(?:\(.*\)\s*+)?{[^}]*+}",
    "([\\/\\\\].*:\\s+.*\\s\\\\$|: \\\\$|^[ %]:|^[\\w\\s\\/\\\\.]+\\w+\\.\\w+\\s*:\\s+[\\w\\s\\/\\\\.]+\\w+\\.\\w+)":
        r"^[^\/\\\r\n]*+[\/\\].*:\s+.*\s\\$|: \\$|^[ %]:|^" + _TARGET + r"*(?:" + _TARGET + r"|\r\n?|\n)\w\.\w++\s*+:\s[\w\s\/\\.]+\w\.\w",
    "^\\s*(?:public\\s+|private\\s+|\\s*)function\\s+\\w+\\s*\\([\\w\\s,]*\\)\\s*{": r"^\s*(?:public\s+|private\s+)?function\s+\w+\s*\([\w\s,]*\)\s*{",
    "(?:^|<)\\s*[A-Za-z0-9_]+\\s*=\\s*<": r"(?:^[ \t\x0B\f]*+|<\s*+)[A-Za-z0-9_]++\s*+=\s*+<",
    "package\\s+\\w+|\\b(?:im|ex)port\\s*\"[\\w:./]+\"|\\w+\\s*::\\s*(?:proc|struct)\\s*\\(|^\\s*//\\s": r'package\s+\w|\b(?:im|ex)port\s*"[\w:./]+"|\w\s*+::\s*(?:proc|struct)\s*\(|^\s*//\s',
    "^\\s+\\w+\\s+=>\\s": r"^[ \t\x0B\f]*(?:[ \t\x0B\f]|\r\n?|\n)\w++\s++=>\s",
    "(?i:\\w+\\s*=\\s*)": r"\w\s*+=",
    "((?i:[A-Z.][\\w.]*:{)|(^|\\n)\\\\(cd?|d|l|p|ts?) )": r"(?i:(?<![\w.])[0-9_]*+[A-Z.][\w.]*+:{)|(^|\n)\\(cd?|d|l|p|ts?) ",
    "^[^#!;][^=]*=": r"\A(?:[#!;][^\r\n]*+(?:\r\n?|\n))*+[^#!;][^=]*+=",
    "^[^#!][^:]*:": r"\A(?:[#!][^\r\n]*+(?:\r\n?|\n))*+[^#!][^:]*+:",
    "^[^#]*:-": r"^[^#\r\n]*:-",
    "^[^\\[#]+:-": r"^[^\[#\r\n]*(?:[^\[#\r\n]|\r\n?|\n):-",
    "(^\\s*module)|let rec |match\\s+(\\S+\\s)+with": r"^\s*module|let rec |match\s++(?:\S++\s(?!with))*+\S++\swith",
    "=> |case\\s+(\\S+\\s)+of": r"=> |case\s++(?:\S++\s(?!of))*+\S++\sof",
    "^[^#]+:-": r"^[^#\r\n]*(?:[^#\r\n]|\r\n?|\n):-",
}
