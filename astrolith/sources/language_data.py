"""The language dimension, a line each: name | type (p programming, m markup, d data, t text; * popular) | endings | file names | interpreters | aliases besides the name in lower case."""

from __future__ import annotations

TYPES = {"p": "programming", "m": "markup", "d": "data", "t": "prose"}
TABLE = """
Python|p*|.py .pyi .pyw .pyx3|SConstruct wscript .pythonrc|python python2 python3 pypy pypy3|python3 py
Go|p*|.go|||golang
JavaScript|p*|.js .cjs .mjs .jsx .es6|Jakefile|node nodejs deno bun|js node
TypeScript|p*|.ts .cts .mts||ts-node tsx|ts
Java|p*|.java .jav .jsh||jshell|
C|p*|.c .h .cats .idc||tcc|
C++|p*|.cpp .cc .cxx .c++ .hpp .hh .hxx .h .ipp .tpp .inl .ixx|||cpp
C#|p*|.cs .csx .cake|||csharp cake
Rust|p*|.rs .rs.in||rust-script cargo|rs
Ruby|p*|.rb .rake .gemspec .ru .rbw .podspec .jbuilder|Rakefile Gemfile Podfile Vagrantfile Guardfile Capfile Brewfile Fastfile Thorfile .irbrc .pryrc|ruby jruby macruby rbx|rb jruby
PHP|p*|.php .phtml .php3 .php4 .php5 .phps .inc|.php_cs .php-cs-fixer.php|php|inc
Shell|p*|.sh .bash .zsh .ksh .bats .command|.bashrc .profile .bash_profile .bash_logout .zshrc .zprofile .zshenv .kshrc PKGBUILD|sh bash zsh dash ksh mksh ash rc|sh bash zsh shell-script
Perl|p|.pl .pm .perl .ph .plx .psgi .t .al .cgi|Makefile.PL cpanfile Rexfile|perl cperl|cperl
Raku|p|.raku .rakumod .p6 .pm6 .pl6 .nqp .t||raku perl6 rakudo|perl6
Prolog|p|.pl .pro .prolog .plt .yap||swipl yap|
Lua|p*|.lua .rockspec .wlua .nse|.luacheckrc|lua luajit|
Scala|p*|.scala .sbt .sc .kojo||scala|
Kotlin|p*|.kt .kts .ktm||kotlin|
Swift|p*|.swift||swift|
R|p*|.r .rd .rsx|.Rprofile expr-dist|Rscript|rscript splus
SQL|d|.sql .ddl .dml .tab .udf .viw .prc .cql|||
PLSQL|p|.pls .pck .pkb .pks .plb .plsql .sql .bdy .fnc .spc|||
PLpgSQL|p|.pgsql .sql|||
TSQL|p|.tsql .sql|||
JSON|d|.json .geojson .webmanifest .avsc .har .topojson .mcmeta .jsonl|.all-contributorsrc .arcconfig composer.lock .watchmanconfig Pipfile.lock .htmlhintrc||geojson jsonl
JSON5|d|.json5|||
JSON with Comments|d|.jsonc .code-workspace .sublime-settings|tsconfig.json jsconfig.json .babelrc .eslintrc.json devcontainer.json||jsonc
JSONLD|d|.jsonld|||
YAML|d|.yml .yaml .mir .reek .sublime-syntax|.clang-format .clang-tidy .gemrc pixi.lock CITATION.cff glide.lock yarn.lock||yml
TOML|d|.toml|Pipfile poetry.lock Cargo.lock uv.lock Gopkg.lock||
XML|d|.xml .xsd .xsl .rss .atom .svg .wsdl .xlf .csproj .vbproj .fsproj .props .targets .plist .xaml .kml .gpx .iml .jelly .nuspec .ui .urdf .xmi .rdf .storyboard .ts .ttf .mod|.classpath .project App.config NuGet.config Web.config||rss xsd wsdl
XSLT|p|.xslt .xsl|||xsl
SVG|d|.svg|||
HTML|m*|.html .htm .xht .xhtml .hta .html.hl .inc|||xhtml
CSS|m*|.css|||
SCSS|m|.scss|||
Sass|m|.sass|||
Less|m|.less|||less-css
Stylus|m|.styl|||
PostCSS|m|.pcss .postcss|||
Markdown|t*|.md .markdown .mdown .mkd .mkdn .livemd .ronn .scd .workbook|README.md contents.lr||md pandoc
MDX|m|.mdx|||
reStructuredText|t|.rst .rest .rst.txt|||rst
AsciiDoc|t|.adoc .asciidoc .asc|||
Org|t|.org|||
Textile|t|.textile|||
RDoc|t|.rdoc|||
MediaWiki|t|.mediawiki .wiki|||
Text|t|.txt .fr .nb .ncl .no|LICENSE COPYING README INSTALL NEWS HOWTO||fundamental plain-text
Roff Manpage|m|.mdoc .man|||manpage man man-page mdoc
Roff|m|.roff .man .me .ms .nr .rno .tmac .n|mmn mmt||groff nroff troff
TeX|m|.tex .aux .bbx .cls .dtx .ins .lbx .ltx .mkii .mkiv .sty .toc|||latex
BibTeX|m|.bib .bibtex|||
BibTeX Style|p|.bst|||
Makefile|p*|.mk .mak .mkfile .make .d|Makefile GNUmakefile makefile BSDmakefile Kbuild Makefile.am Makefile.in mkfile|make|bsdmake make mf
CMake|p|.cmake .cmake.in|CMakeLists.txt||
Ninja|d|.ninja|||
Meson|p||meson.build meson_options.txt||
Starlark|p|.bzl .star|BUILD BUILD.bazel WORKSPACE WORKSPACE.bazel MODULE.bazel Tiltfile||bazel bzl
Just|p|.just|justfile Justfile .justfile||
Earthly|p||Earthfile||
Dockerfile|p*|.dockerfile .containerfile|Dockerfile Containerfile||containerfile
Vim Script|p|.vim .vba .vimrc .vmb|.vimrc .gvimrc _vimrc .nvimrc vimrc||vim viml nvim vimscript
Vim Help File|t|.txt|||help vimhelp
Emacs Lisp|p|.el .emacs|.emacs .spacemacs Cask Project.ede||elisp emacs
Common Lisp|p|.lisp .asd .cl .l .lsp .ny .podsl .sexp||sbcl clisp ecl ccl lisp|lisp
Scheme|p|.scm .sch .sld .sls .sps .ss||guile scheme csi gosh|
Racket|p|.rkt .rktd .rktl .scrbl||racket|
Clojure|p|.clj .cljc .cljs .cljx .edn .boot .bb|riemann.config|bb clojure|
edn|d|.edn|||
Haskell|p|.hs .hs-boot .hsc||runghc runhaskell stack|
Literate Haskell|p|.lhs|||lhs
OCaml|p|.ml .mli .mll .mly .eliom .ml4||ocaml ocamlrun|
Standard ML|p|.ml .sml .sig .fun|||sml
ReasonML|p|.re .rei|||
ReScript|p|.res .resi||ocaml|
F#|p|.fs .fsi .fsx|||fsharp
F*|p|.fst .fsti|||fstar
Erlang|p|.erl .hrl .app .app.src .escript .xrl .yrl|rebar.config rebar.lock Emakefile|escript|
Elixir|p|.ex .exs|mix.lock|elixir|
Elm|p|.elm|||
PureScript|p|.purs|||
Idris|p|.idr .lidr|||
Agda|p|.agda|||
Coq|p|.v .coq|||
Lean|p|.lean .hlean|||
Isabelle|p|.thy|ROOT||
Dart|p|.dart||dart|
Julia|p|.jl||julia|
Nim|p|.nim .nimble .nims .nimrod|nim.cfg||
Zig|p|.zig .zig.zon|||
V|p|.v .vv|||vlang
D|p|.d .di|||dlang
Crystal|p|.cr||crystal|
Groovy|p|.groovy .grt .gtpl .gvy|Jenkinsfile|groovy|
Gradle|d|.gradle|||
Objective-C|p|.m .h|||objc obj-c objectivec
Objective-C++|p|.mm|||objc++ objectivec++
MATLAB|p|.matlab .m|||octave
Mercury|p|.m .moo||mmi|
Mathematica|p|.mathematica .cdf .m .ma .nb .wl .wlt|||mma wolfram
Fortran|p|.f .f77 .for .fpp|||
Fortran Free Form|p|.f90 .f03 .f08 .f95|||
COBOL|p|.cob .cbl .ccp .cobol .cpy|||
Pascal|p|.pas .dfm .dpr .inc .lpr .pascal .pp||instantfpc|delphi objectpascal
Ada|p|.adb .ada .ads|||ada95
Assembly|p|.asm .a51 .i .inc .nas .nasm .s|||asm nasm
Unix Assembly|p|.s .ms|||gas
Motorola 68K Assembly|p|.asm .i .inc .s .x68|||m68k
WebAssembly|p|.wast .wat|||wasm
LLVM|p|.ll|||
Cuda|p|.cu .cuh|||
OpenCL|p|.cl .opencl|||
GLSL|p|.glsl .frag .vert .geom .comp .fs .vs .gs .shader .tesc .tese .rgen|||
HLSL|p|.hlsl .cginc .fx .fxh .hlsli|||
Metal|p|.metal|||
WGSL|p|.wgsl|||
ShaderLab|p|.shader|||
Verilog|p|.v .veo|||
SystemVerilog|p|.sv .svh .vh|||
VHDL|p|.vhdl .vhd .vhf .vhi .vho .vhs .vht .vhw|||
Bluespec|p|.bsv|||
Chisel|p|.chisel|||
Tcl|p|.tcl .adp .sdc .tcl.in .tm .xdc|owh starfield|tclsh wish|sdc xdc
Awk|p|.awk .auk .gawk .mawk .nawk||awk gawk mawk nawk|
sed|p|.sed||sed gsed ssed|
PowerShell|p*|.ps1 .psd1 .psm1||pwsh|posh pwsh
Batchfile|p|.bat .cmd|||bat batch dosbatch winbatch
fish|p|.fish||fish|
Nushell|p|.nu||nu|
Tcsh|p|.tcsh .csh||tcsh csh|csh
Elvish|p|.elv||elvish|
Nix|p|.nix|flake.lock||nixos
Dhall|p|.dhall|||
Jsonnet|p|.jsonnet .libsonnet|||
CUE|p|.cue|||
HCL|p|.hcl .tf .tfvars .nomad .workflow|.terraform.lock.hcl||terraform
Rego|p|.rego|||
Puppet|p|.pp|Modulefile||
SaltStack|p|.sls|||salt
Pug|m|.jade .pug|||
Haml|m|.haml .haml.deface|||
Slim|m|.slim|||
HTML+ERB|m|.erb .erb.deface .rhtml .html.erb|||erb rhtml
HTML+EEX|m|.eex .heex .leex|||eex heex
HTML+PHP|m|.phtml|||
HTML+Razor|m|.cshtml .razor|||razor
Handlebars|m|.handlebars .hbs|||hbs htmlbars
Mustache|m|.mustache|||
Jinja|m|.jinja .j2 .jinja2|||django htmldjango
Twig|m|.twig|||
Liquid|m|.liquid|||
Blade|m|.blade .blade.php|||
EJS|m|.ejs .ect .ejs.t .jst|||
Nunjucks|m|.njk|||
Smarty|m|.tpl|||
FreeMarker|p|.ftl .ftlh|||ftl
Velocity Template Language|m|.vtl|||vtl velocity
Java Server Pages|p|.jsp .tag|||jsp
ASP.NET|p|.asax .ascx .ashx .asmx .aspx .axd|||aspx
Classic ASP|p|.asp|||asp
ColdFusion|p|.cfm .cfml|||cfm cfml
ColdFusion CFC|p|.cfc|||cfc
Vue|m|.vue|||
Svelte|m|.svelte|||
Astro|m|.astro|||
Marko|m|.marko|||
CoffeeScript|p|.coffee ._coffee .cjsx .iced|Cakefile|coffee|coffee coffee-script
LiveScript|p|.ls ._ls|Slakefile||live-script ls
ActionScript|p|.as|||as3
Haxe|p|.hx .hxsl|||
AppleScript|p|.applescript .scpt||osascript|osascript
AutoHotkey|p|.ahk .ahkl|||ahk
AutoIt|p|.au3|||au3
Visual Basic .NET|p|.vb .vbhtml|||vb.net vbnet
VBA|p|.bas .cls .frm .vba|||
VBScript|p|.vbs|||
Visual Basic 6.0|p|.bas .cls .ctl .frm|||vb6
FreeBASIC|p|.bi .bas|||fb
PureBasic|p|.pb .pbi|||
BASIC|p|.bas|||
Apex|p|.cls .apex .trigger|||
ABAP|p|.abap|||
SAS|p|.sas|||
Stata|p|.do .ado .doh .ihlp .mata .matah .sthlp|||
SPSS|p|.sps|||
Solidity|p|.sol|||
Vyper|p|.vy|||
Move|p|.move|||
Cairo|p|.cairo|||
Clarity|p|.clar|||
Cadence|p|.cdc|||
Protocol Buffer|d|.proto|||protobuf proto
Thrift|p|.thrift|||
Cap'n Proto|p|.capnp|||
FlatBuffers|d|.fbs|||
GraphQL|d|.graphql .gql .graphqls|||
Avro IDL|d|.avdl|||
ASN.1|d|.asn .asn1|||
WebIDL|p|.webidl|||
IDL|p|.pro .dlm|||
INI|d|.ini .cfg .cnf .dof .lektorproject .prefs .pro .properties .url .frm|.editorconfig .gitconfig .flake8 .pylintrc .coveragerc pylintrc||dosini
Java Properties|d|.properties|||
EditorConfig|d|.editorconfig|.editorconfig||
Git Config|d|.gitconfig|.gitconfig .gitmodules||gitconfig gitmodules
Git Attributes|d||.gitattributes||gitattributes
Ignore List|d|.gitignore|.gitignore .dockerignore .npmignore .eslintignore .prettierignore .stylelintignore .vscodeignore .hgignore .cvsignore||ignore gitignore
Dotenv|d|.env|.env .env.local .env.example||
Nginx|d|.nginx .nginxconf .vhost|nginx.conf||
ApacheConf|d|.apacheconf .vhost|.htaccess apache2.conf httpd.conf||apache aconf
HAProxy|d|haproxy.cfg|haproxy.cfg||
Caddyfile|d|.caddyfile|Caddyfile||caddy
systemd|d|.service .socket .timer .mount|||
Desktop|d|.desktop .desktop.in .service|||
Debian Package Control File|d|.dsc|||
RPM Spec|d|.spec|||specfile
CSV|d|.csv|||
TSV|d|.tsv .vcf|||
Diff|d|.diff .patch|||udiff patch
Jupyter Notebook|m|.ipynb|Notebook||ipython-notebook
R Markdown|t|.qmd .rmd|||rmarkdown
Rich Text Format|m|.rtf|||
PostScript|m|.ps .eps .epsi .pfa|||postscr
Gnuplot|p|.gp .gnu .gnuplot .p .plot .plt||gnuplot|
DOT|d|.dot .gv|||graphviz
Mermaid|m|.mmd .mermaid|||
PlantUML|d|.puml .iuml .plantuml|||
Graphviz (DOT)|d|.gvpr|||
Gherkin|p|.feature .story|||cucumber
RobotFramework|p|.robot .resource|||
Cypher|p|.cyp .cypher|||
SPARQL|d|.sparql .rq|||
Turtle|d|.ttl|||
N-Triples|d|.nt|||
RDF Notation|d|.n3|||
Datalog|p|.dl|||
SuperCollider|p|.sc .scd||sclang scsynth|
Csound|p|.csd .orc .sco|||
ChucK|p|.ck|||
Faust|p|.dsp|||
Pure Data|d|.pd|||
Max|p|.maxpat .maxhelp .maxproj .mxt .pat|||max/msp maxmsp
Processing|p|.pde|||
Arduino|p|.ino|||
OpenSCAD|p|.scad|||
G-code|d|.g .cnc .gco .gcode|||
STL|d|.stl|||
Wavefront Object|d|.obj|||
Wavefront Material|d|.mtl|||
COLLADA|d|.dae|||
glTF|d|.gltf|||
Unity3D Asset|d|.anim .asset .mask .mat .meta .prefab .unity|||
GDScript|p|.gd|||
Godot Resource|d|.tscn .tres .gdnlib .gdns|project.godot||
UnrealScript|p|.uc|||
Papyrus|p|.psc|||
Squirrel|p|.nut|||
AngelScript|p|.as .angelscript|||
Game Maker Language|p|.gml|||
Ren'Py|p|.rpy|||renpy
Ink|p|.ink|||
Twine|m|.twee .tw|||
Inform 7|p|.ni .i7x|||i7 inform7
TADS|p|.t|||
Z80 Assembly|p|.z80|||
6502 Assembly|p|.a65 .s65|||
Forth|p|.fth .4th .f .for .forth .fr .frt .fs|||
Factor|p|.factor|.factor-rc||
PostgreSQL Dump|d|.psql|||
APL|p|.apl .dyalog||apl dyalog|
J|p|.ijs||jconsole|
K|p|.k|||
Q|p|.q|||
BQN|p|.bqn||bqn|
Uiua|p|.ua|||
Smalltalk|p|.st .cs|||squeak
Self|p|.self|||
Io|p|.io||io|
Ioke|p|.ik||ioke|
Pony|p|.pony|||
Red|p|.red .reds|||
Rebol|p|.reb .r .r2 .r3 .rebol|||
Rexx|p|.rexx .pprx .rex||regina rexx|arexx
Eiffel|p|.e|||
E|p|.e||rune|
Modula-2|p|.mod|||
Modula-3|p|.i3 .ig .m3 .mg|||
Oberon|p|.ob2|||
Component Pascal|p|.cp .cps|||
Oz|p|.oz|||
Curry|p|.curry|||
Clean|p|.icl .dcl|||
Nemerle|p|.n|||
Boo|p|.boo|||
Cython|p|.pyx .pxd .pxi|||pyrex
Mojo|p|.mojo|||
Hack|p|.hack .hh .hhi .php|||
Zephir|p|.zep|||
Ceylon|p|.ceylon|||
Xtend|p|.xtend|||
Golo|p|.golo|||
Frege|p|.fr|||
Eta|p|.eta|||
Ballerina|p|.bal|||
Odin|p|.odin|||
Jai|p|.jai|||
Vala|p|.vala .vapi|||
Genie|p|.gs|||
Carbon|p|.carbon|||
Val|p|.val|||
Roc|p|.roc|||
Gleam|p|.gleam|||
Grain|p|.gr|||
Koka|p|.kk|||
Unison|p|.u|||
Flix|p|.flix|||
Futhark|p|.fut|||
Chapel|p|.chpl|||chpl
X10|p|.x10|||
ParaSail|p|.psi|||
Halide|p|.halide|||
Opa|p|.opa|||
Ur|p|.ur .urs|||ur/web
LSL|p|.lsl .lslp||lsl|
Bro|p|.zeek .bro|||zeek
YARA|p|.yar .yara|||
Snort Rules|d|.snort|||
Suricata|d|.rules|||
Sieve|p|.sieve|||
Procfile|p||Procfile||
Gemfile.lock|d||Gemfile.lock||
Go Checksums|d||go.sum go.work.sum||go.sum
Go Module|d||go.mod||go.mod
Go Workspace|d||go.work||go.work
Pip Requirements|d||requirements.txt requirements-dev.txt dev-requirements.txt||
NPM Config|d||.npmrc||npmrc
cURL Config|d||.curlrc _curlrc||curlrc
Wget Config|d||.wgetrc||wgetrc
Readline Config|d||.inputrc inputrc||inputrc readline
SSH Config|d||ssh_config sshd_config||sshconfig
Hosts File|d||hosts hosts.txt||hosts
Browserslist|d||.browserslistrc browserslist||
Record Jar|d||language-subtag-registry.txt||
robots.txt|d||robots.txt||robots
Public Key|d|.asc .pub|||
Checksums|d|.sha1 .sha2 .sha256 .sha512 .md5 .crc32|MD5SUMS SHA1SUMS SHA256SUMS checksums.txt||
Linker Script|p|.ld .lds .x|||
M4|p|.m4 .mc|||
M4Sugar|p|.m4|configure.ac||autoconf
Yacc|p|.y .yacc .yy|||
Lex|p|.l .lex|||flex
Bison|p|.bison|||
ANTLR|p|.g4|||
Ragel|p|.rl|||ragel-rb
PEG.js|p|.pegjs .peggy|||
EBNF|d|.ebnf|||
ABNF|d|.abnf|||
Grammatical Framework|p|.gf|||gf
TLA|p|.tla|||
Alloy|p|.als|||
Promela|p|.pml|||
Dafny|p|.dfy||dafny|
Boogie|p|.bpl||boogie|
Why3|p|.mlw|||
SMT|p|.smt2 .smt .z3||z3 cvc4|
AMPL|p|.ampl .mod|||
GAMS|p|.gms|||
MiniZinc|p|.mzn|||
MiniZinc Data|d|.dzn|||
LilyPond|p|.ly .ily|||
ABC Notation|d|.abc|||
Genshi|p|.kid|||
Mako|p|.mako .mao|||
Cheetah|p|.tmpl|||
Tea|m|.tea|||
Latte|m|.latte|||
Fluent|p|.ftl|||
Gettext Catalog|t|.po .pot|||pot
SubRip Text|d|.srt|||
WebVTT|d|.vtt|||
iCalendar|d|.ics .ical|||
vCard|d|.vcf|||
Email|d|.eml .mbox|||
HTTP|d|.http|||
HXML|d|.hxml|||
QML|p|.qml .qbs|||
QMake|p|.pro .pri||qmake|
Qt Script|p|.qs|||
Slint|m|.slint|||
Blueprint|m|.blp|||
XUL|m|.xul|||
XProc|p|.xpl .xproc|||
XQuery|p|.xquery .xq .xql .xqm .xqy|||
XPages|d|.xsp-config|||
RELAX NG|d|.rng|||
RNC|d|.rnc|||
DTD|d|.dtd|||
DTrace|p|.d||dtrace|
SystemTap|p|.stp||stap|
BitBake|p|.bb .bbappend .bbclass|||
Kickstart|d|.ks|||
Device Tree|d|.dts .dtsi|||
Kconfig|d||Kconfig||
Linux Kernel Module|d|.mod|||
U-Boot Script|d|.its|||
NSIS|p|.nsi .nsh|||
Inno Setup|p|.iss .isl|||
WiX|d|.wxs .wxi|||
Module Management System|p|.mms .mmk|descrip.mms||
DIGITAL Command Language|p|.com|||dcl
JCL|p|.jcl|||
PL/I|p|.pli|||
RPGLE|p|.rpgle .sqlrpgle|||
MUMPS|p|.mumps|||
Caché ObjectScript|p|.mac|||
OpenEdge ABL|p|.p .cls .w|||progress abl
xBase|p|.prg .ch .prw|||foxpro clipper
PowerBuilder|p|.pbt .sra .sru .srw|||
Harbour|p|.hb|||
LabVIEW|p|.lvproj .lvlib|||
Structured Text|p|.iecst|||
Ladder|d|.ld5|||
NetLogo|p|.nlogo|||
Logtalk|p|.lgt .logtalk|||
ECLiPSe|p|.ecl|||
Answer Set Programming|p|.lp||clingo|
Linear Programming|d|.lpt|||
NumPy|p|.numpy .numpyw .numsc|||
Sage|p|.sage .sagews|||
GAP|p|.g .gap .gd .gi .tst|||
Magma|p|.magma|||
Macaulay2|p|.m2||M2|m2
Maple|p|.mpl|||
Scilab|p|.sci .sce .tst|||
JAGS|p|.jags .bug|||
Stan|p|.stan|||
BUGS|p|.bugs|||
PRQL|d|.prql|||
KQL|d|.kql|||
LookML|p|.lkml .lookml|||
DAX|p|.dax|||
Power Query|p|.pq .pqm|||
Terraform Template|m|.tftpl|||
Bicep|p|.bicep .bicepparam|||
Pulumi|d|.pulumi|||
Smithy|p|.smithy|||
RAML|m|.raml|||
API Blueprint|m|.apib|||
OpenAPI|d|.oas|||
TypeSpec|p|.tsp|||
WebC|m|.webc|||
Imba|p|.imba|||
Civet|p|.civet|||
Wren|p|.wren||wren|
Janet|p|.janet||janet|
Fennel|p|.fnl||fennel|
Hy|p|.hy||hy|
LFE|p|.lfe|||
Shen|p|.shen|||
newLISP|p|.nl .lisp .lsp||newlisp|
PicoLisp|p|.l||picolisp pil|
AutoLISP|p|.lsp .mnl|||
Moonscript|p|.moon||moon|
Terra|p|.t||lua|
Teal|p|.tl|||
Luau|p|.luau||luau|
Volt|p|.volt|||
""".strip()


def rows() -> list[tuple[str, str, bool, list[str], list[str], list[str], list[str]]]:
    """(name, type, popular, endings, file names, interpreters, aliases), the name in lower case, with - for a space, being the first alias."""
    out = []
    for line in TABLE.split("\n"):
        name, kind, endings, files, interpreters, aliases = line.split("|")
        out.append((name, TYPES[kind[0]], kind.endswith("*"), endings.split(), files.split(), interpreters.split(), [name.lower().replace(" ", "-"), *aliases.split()]))
    return out


#: What an ending means where nothing else tells.
PREFERRED = {".md": "Markdown", ".html": "HTML", ".rs": "Rust", ".sql": "SQL", ".ts": "TypeScript", ".php": "PHP", ".json": "JSON", ".m": "Objective-C", ".pl": "Perl", ".r": "R", ".d": "D", ".v": "Verilog", ".fs": "F#", ".cls": "Apex", ".h": "C", ".cs": "C#", ".txt": "Text", ".yml": "YAML", ".xml": "XML", ".tex": "TeX", ".s": "Assembly", ".t": "Perl", ".toml": "TOML"}
#: (endings, [(language, Java pattern that the text must have, None for always)]): the first that holds decides between languages of one ending.
HEURISTICS: list[tuple[list[str], list[tuple[str, str | None]]]] = [
    ([".h"], [("Objective-C", r"(?m)^\s*(?:@(?:end|implementation|interface|property|protocol)\b|#import\b)"), ("C++", r"(?m)^\s*(?:#\s*include\s*<\w+>|template\s*<|namespace\b|class\s+\w+|using\s+namespace\b)|\bstd::"), ("C", None)]),
    ([".m"], [("Objective-C", r"(?m)^\s*(?:@(?:end|implementation|interface|property|protocol)\b|#import\b)"), ("Mercury", r":- module"), ("Mathematica", r"\(\*|^BeginPackage"), ("MATLAB", r"(?m)^\s*(?:%|function\b|classdef\b)")]),
    ([".pl"], [("Prolog", r"(?m)^[^#]*:-"), ("Raku", r"(?m)^\s*(?:use\s+v6\b|(?:my\s+)?class\s+\w+|module\s+\w+\s*;?\s*$)"), ("Perl", r"(?m)\buse\s+(?:strict\b|warnings\b|v?5\b)|^\s*(?:sub\s+\w+|my\s+[$@%])|\$_")]),
    ([".pm"], [("Raku", r"(?m)^\s*(?:use\s+v6\b|(?:my\s+)?class\s+\w+\s*(?:is|does)?)"), ("Perl", None)]),
    ([".r"], [("Rebol", r"(?i)\bRebol\b"), ("R", r"<-|(?m)^\s*#|\blibrary\(")]),
    ([".ts"], [("XML", r"<TS\b"), ("TypeScript", None)]),
    ([".d"], [("Makefile", r"(?m)^[\w./-]+\.o\s*:"), ("DTrace", r"(?m)^\s*(?:#pragma\s+D\s+option|\w*:\w*:\w*:\w*|BEGIN\s*$)"), ("D", r"(?m)^\s*(?:module\s+[\w.]+\s*;|import\s+[\w.\s,:]+;|unittest\b)")]),
    ([".v"], [("Coq", r"(?m)^\s*(?:Require|Import|Theorem|Lemma|Proof|Definition|Inductive|Qed)\b"), ("Verilog", r"(?m)^\s*(?:module\s+\w+\s*[#(;]|endmodule|`(?:define|ifdef|include|timescale))"), ("V", r"(?m)^\s*(?:fn\s+\w+|module\s+\w+\s*$|import\s+\w+)")]),
    ([".fs"], [("F#", r"(?m)^\s*(?:#light|import\b|let\b|module\b|namespace\b|open\b|type\b)"), ("GLSL", r"(?m)^\s*(?:#version|precision|uniform|varying|vec[234])\b"), ("Forth", r"(?m)^(?:: |new-device)")]),
    ([".ml"], [("OCaml", r"(?m)^\s*(?:let\s+rec\b|module\s+\w+\s*=|open\s+\w+|match\b.*\bwith\b)|\bfunction\s*\||;;"), ("Standard ML", r"=> |case\s+(?:\S+\s)+of|(?m)^\s*(?:structure|signature|fun)\s")]),
    ([".cl"], [("Common Lisp", r"(?im)^\s*\((?:defun|in-package|defpackage|defmacro)\b"), ("OpenCL", r"/\* |// |(?m)^\}|__kernel")]),
    ([".cls"], [("TeX", r"(?m)^\s*\\(?:NeedsTeXFormat|ProvidesClass)\{"), ("Visual Basic 6.0", r"(?m)^VERSION\s+\d"), ("OpenEdge ABL", r"(?im)^\s*(?:using|class)\s+[\w.]+.*\.\s*$"), ("Apex", r"(?i)\b(?:public|private|global)\s+(?:with sharing\s+|virtual\s+)?class\b")]),
    ([".pro"], [("Prolog", r"(?m)^[^\[#]+:-"), ("INI", r"last_client="), ("QMake", r"(?s)HEADERS.*SOURCES|TEMPLATE\s*="), ("IDL", r"(?im)^\s*(?:function|pro)\s+\w+")]),
    ([".php"], [("Hack", r"<\?hh"), ("PHP", r"<\?[^h]")]),
    ([".sql"], [("PLpgSQL", r"(?i)\$\$\s*(?:declare|begin)|language\s+'?plpgsql"), ("TSQL", r"(?im)^\s*GO\b|\bBEGIN\s+TRY\b|DECLARE\s+@\w+"), ("PLSQL", r"(?i)\bCREATE\s+OR\s+REPLACE\s+(?:PACKAGE|PROCEDURE)\b|\bPRAGMA\b"), ("SQL", None)]),
    ([".inc"], [("PHP", r"^<\?(?:php)?"), ("Pascal", r"(?im)^\s*\{\$|\bunit\s+\w+;"), ("Assembly", r"(?im)^\s*(?:\.\w+|%(?:define|macro)|mov\b)"), ("HTML", r"<\w+[\s>]")]),
    ([".t"], [("Raku", r"(?m)^\s*use\s+v6\b"), ("Perl", r"\buse\s+(?:strict|warnings|Test::\w+)\b"), ("Terra", r"(?m)^\s*terra\s+\w+")]),
    ([".s", ".ms"], [("Roff", r"(?m)^[.'][A-Za-z]{2}(?:\s|$)"), ("Unix Assembly", r"(?m)^\s*\.(?:text|globl|section|type)\b"), ("Assembly", None)]),
    ([".lsp", ".lisp"], [("newLISP", r"(?m)^\s*\(define\s"), ("Common Lisp", r"(?im)^\s*\((?:defun|in-package|defpackage)\b")]),
    ([".md"], [("Markdown", None)]),
    ([".mod"], [("XML", r"<!ENTITY "), ("AMPL", r"(?m)^\s*(?:param|set|var|minimize|maximize)\b"), ("Modula-2", r"(?m)^\s*(?:MODULE|END)\s+[\w.]+;"), ("Linux Kernel Module", None)]),
    ([".as"], [("ActionScript", r"(?m)^\s*(?:package\s+[\w.]+|import\s+[\w.]+;|(?:public|private)\s+(?:class|function))"), ("AngelScript", None)]),
    ([".f", ".for"], [("Forth", r"(?m)^: "), ("Fortran", r"(?im)^(?:[c*][^abd-z]|      (?:subroutine|program|end|data)\s|\s*!)")]),
    ([".cs"], [("Smalltalk", r"![\w\s]+methodsFor: "), ("C#", r"(?m)^\s*(?:using\s+[\w.]+\s*;|namespace\s+[\w.]+|//|(?:public|internal)\s)")]),
    ([".gs"], [("GLSL", r"(?m)^#version\s"), ("Genie", r"(?m)^\s*init\s*$"), ("JavaScript", None)]),
]
