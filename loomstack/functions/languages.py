"""Declaration patterns and file extensions by language."""

from __future__ import annotations

#: One pattern a line, in the order in which they are tried: language, blank, regular expression.
DECLARATIONS = r"""
javascript ^(?:export\s+)?(?:async\s+)?function\s+(\w+)
javascript ^(?:export\s+)?class\s+(\w+)
javascript ^(?:export\s+)?const\s+(\w+)\s*=
javascript ^(?:export\s+)?let\s+(\w+)\s*=
javascript (\w+)\s*[=:]\s*(?:async\s+)?\([^)]*\)\s*(?:=>|{)
javascript (\w+)\s*\([^)]*\)\s*{
typescript ^(?:export\s+)?(?:async\s+)?function\s+(\w+)
typescript ^(?:export\s+)?class\s+(\w+)
typescript ^(?:export\s+)?interface\s+(\w+)
typescript ^(?:export\s+)?type\s+(\w+)\s*=
typescript ^(?:export\s+)?const\s+(\w+)\s*[=:]
typescript ^(?:export\s+)?enum\s+(\w+)
typescript (\w+)\s*[=:]\s*(?:async\s+)?\([^)]*\)\s*(?:=>|{)
typescript (\w+)\s*\([^)]*\)\s*(?::\s*\w+)?\s*{
python ^(?:async\s+)?def\s+(\w+)
python ^class\s+(\w+)
vue ^(?:export\s+)?(?:async\s+)?function\s+(\w+)
vue ^(?:export\s+)?const\s+(\w+)\s*=
vue (\w+)\s*[=:]\s*(?:async\s+)?\([^)]*\)\s*(?:=>|{)
vue (\w+)\s*\([^)]*\)\s*{
go ^func\s+(?:\([^)]+\)\s+)?(\w+)
go ^type\s+(\w+)\s+(?:struct|interface)
rust ^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)
rust ^(?:pub\s+)?struct\s+(\w+)
rust ^(?:pub\s+)?enum\s+(\w+)
rust ^(?:pub\s+)?trait\s+(\w+)
rust ^impl(?:<[^>]+>)?\s+(\w+)
java ^(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?class\s+(\w+)
java ^(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?interface\s+(\w+)
java ^(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:\w+\s+)+(\w+)\s*\(
php ^\s*namespace\s+([\w\\]+)
php ^\s*(?:final\s+|abstract\s+)?class\s+(\w+)
php ^\s*interface\s+(\w+)
php ^\s*trait\s+(\w+)
php ^\s*(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)
php ^\s*const\s+(\w+)\s*=
ruby ^def\s+(\w+)
ruby ^class\s+(\w+)
ruby ^module\s+(\w+)
csharp ^(?:public|private|protected|internal)?\s*(?:static\s+)?(?:partial\s+)?class\s+(\w+)
csharp ^(?:public|private|protected|internal)?\s*interface\s+(\w+)
csharp ^(?:public|private|protected|internal)?\s*(?:static\s+)?(?:async\s+)?(?:\w+\s+)+(\w+)\s*\(
cpp ^(?:class|struct)\s+(\w+)
cpp ^(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*(?:const)?\s*(?:override)?\s*{
cpp ^namespace\s+(\w+)
c ^(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*{
c ^struct\s+(\w+)
c ^typedef\s+.*\s+(\w+)\s*;
html <(\w+)\s+id="(\w+)"
html <script[^>]*>
html <style[^>]*>
css ^\.(\w[\w-]*)\s*\{
css ^#(\w[\w-]*)\s*\{
css ^@media\s+
css ^@keyframes\s+(\w+)
scss ^\.(\w[\w-]*)\s*\{
scss ^\$(\w[\w-]*)\s*:
scss ^@mixin\s+(\w+)
scss ^@include\s+(\w+)
xml <(\w+)\s+.*?>
sql (?i)^CREATE\s+(?:TABLE|VIEW|FUNCTION|PROCEDURE)\s+(\w+)
sql (?i)^ALTER\s+TABLE\s+(\w+)
sql (?i)^INSERT\s+INTO\s+(\w+)
shell ^(\w+)\s*\(\)\s*\{
shell ^function\s+(\w+)
kotlin ^(?:public|private|internal|protected)?\s*(?:suspend\s+)?fun\s+(\w+)
kotlin ^(?:public|private|internal|protected)?\s*(?:data\s+|sealed\s+|open\s+)?class\s+(\w+)
kotlin ^(?:public|private|internal|protected)?\s*interface\s+(\w+)
kotlin ^(?:public|private|internal|protected)?\s*object\s+(\w+)
kotlin ^(?:public|private|internal|protected)?\s*enum\s+class\s+(\w+)
swift ^(?:public|private|internal|fileprivate|open)?\s*func\s+(\w+)
swift ^(?:public|private|internal|fileprivate|open)?\s*class\s+(\w+)
swift ^(?:public|private|internal|fileprivate|open)?\s*struct\s+(\w+)
swift ^(?:public|private|internal|fileprivate|open)?\s*enum\s+(\w+)
swift ^(?:public|private|internal|fileprivate|open)?\s*protocol\s+(\w+)
swift ^extension\s+(\w+)
scala ^(?:def|override\s+def)\s+(\w+)
scala ^(?:class|case\s+class|abstract\s+class)\s+(\w+)
scala ^(?:object|case\s+object)\s+(\w+)
scala ^trait\s+(\w+)
dart ^(?:Future<[^>]+>|void|int|String|bool|dynamic|\w+)\s+(\w+)\s*\(
dart ^class\s+(\w+)
dart ^(?:abstract\s+)?class\s+(\w+)
dart ^mixin\s+(\w+)
dart ^extension\s+(\w+)
dart ^enum\s+(\w+)
lua ^(?:local\s+)?function\s+(\w+)
lua ^(\w+)\s*=\s*function\s*\(
perl ^sub\s+(\w+)
perl ^package\s+(\w+)
r ^(\w+)\s*<-\s*function
r ^(\w+)\s*=\s*function
julia ^function\s+(\w+)
julia ^(?:mutable\s+)?struct\s+(\w+)
julia ^abstract\s+type\s+(\w+)
julia ^(\w+)\(.*\)\s*=
elixir ^def\s+(\w+)
elixir ^defp\s+(\w+)
elixir ^defmodule\s+(\w+)
elixir ^defmacro\s+(\w+)
clojure ^\(defn\s+(\w+)
clojure ^\(defn-\s+(\w+)
clojure ^\(def\s+(\w+)
clojure ^\(defmacro\s+(\w+)
haskell ^(\w+)\s*::
haskell ^data\s+(\w+)
haskell ^type\s+(\w+)
haskell ^newtype\s+(\w+)
haskell ^class\s+(\w+)
haskell ^instance\s+(\w+)
erlang ^(\w+)\s*\([^)]*\)\s*->
erlang ^-module\((\w+)\)
erlang ^-record\((\w+)
fsharp ^let\s+(\w+)
fsharp ^type\s+(\w+)
fsharp ^module\s+(\w+)
fsharp ^member\s+(?:this|_)\.(\w+)
ocaml ^let\s+(\w+)
ocaml ^type\s+(\w+)
ocaml ^module\s+(\w+)
ocaml ^class\s+(\w+)
zig ^(?:pub\s+)?fn\s+(\w+)
zig ^(?:pub\s+)?const\s+(\w+)\s*=
zig ^(?:pub\s+)?var\s+(\w+)\s*=
nim ^proc\s+(\w+)
nim ^func\s+(\w+)
nim ^method\s+(\w+)
nim ^template\s+(\w+)
nim ^macro\s+(\w+)
nim ^type\s+(\w+)
crystal ^def\s+(\w+)
crystal ^class\s+(\w+)
crystal ^struct\s+(\w+)
crystal ^module\s+(\w+)
crystal ^macro\s+(\w+)
groovy ^def\s+(\w+)
groovy ^(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)?(\w+)\s*\(
groovy ^class\s+(\w+)
groovy ^interface\s+(\w+)
powershell ^function\s+(\w+[\w-]*)
powershell ^filter\s+(\w+[\w-]*)
powershell ^class\s+(\w+)
dockerfile (?i)^FROM\s+(\S+)
dockerfile (?i)^(?:RUN|CMD|ENTRYPOINT|COPY|ADD|ENV|ARG|EXPOSE|WORKDIR|LABEL)\s
terraform ^resource\s+"(\w+)"\s+"(\w+)"
terraform ^data\s+"(\w+)"\s+"(\w+)"
terraform ^module\s+"(\w+)"
terraform ^variable\s+"(\w+)"
terraform ^output\s+"(\w+)"
graphql ^type\s+(\w+)
graphql ^input\s+(\w+)
graphql ^interface\s+(\w+)
graphql ^enum\s+(\w+)
graphql ^scalar\s+(\w+)
graphql ^query\s+(\w+)
graphql ^mutation\s+(\w+)
graphql ^subscription\s+(\w+)
protobuf ^message\s+(\w+)
protobuf ^service\s+(\w+)
protobuf ^enum\s+(\w+)
protobuf ^rpc\s+(\w+)
toml ^\[(\w+)\]
toml ^\[\[(\w+)\]\]
ini ^\[(\w+)\]
make ^(\w[\w-]*)\s*:
make ^\.PHONY:\s*(\w+)
cmake (?i)^function\s*\(\s*(\w+)
cmake (?i)^macro\s*\(\s*(\w+)
cmake (?i)^(?:add_executable|add_library)\s*\(\s*(\w+)
svelte ^(?:export\s+)?(?:async\s+)?function\s+(\w+)
svelte ^(?:export\s+)?const\s+(\w+)\s*=
svelte ^(?:export\s+)?let\s+(\w+)\s*=
astro ^(?:export\s+)?(?:async\s+)?function\s+(\w+)
astro ^(?:export\s+)?const\s+(\w+)\s*=
""".strip().splitlines()

NOT_NAMES = "if else for while switch catch try return new throw".split()
NOISE_NAMES = """
i j k n x y z a b c d e f _ __ ___ tmp temp val var res ret err fn cb el ev id ok no on to do go undefined null true
false this self super if else for while switch case default break continue return throw try catch finally new delete
typeof instanceof void in of as is get set let const function class interface type enum namespace module export import
from extends implements static public private protected abstract final async await yield with debugger
""".split()
NON_CODE = "sql prisma graphql json yaml toml ini xml html css scss sass less stylus markdown dockerfile make cmake terraform protobuf".split()
#: language: extensions
EXTENSIONS = """
typescript: ts tsx mts cts
javascript: js jsx mjs cjs
vue: vue
svelte: svelte
astro: astro
python: py pyw pyi
go: go
rust: rs
zig: zig
nim: nim
c: c h
cpp: cpp cc cxx hpp hh hxx
java: java
kotlin: kt kts
scala: scala sc
groovy: groovy gradle
clojure: clj cljs cljc
csharp: cs
fsharp: fs fsx fsi
visualbasic: vb
php: php phtml
ruby: rb erb rake
perl: pl pm
lua: lua
swift: swift
dart: dart
objectivec: m mm
haskell: hs lhs
ocaml: ml mli
erlang: erl hrl
elixir: ex exs
julia: jl
r: r
crystal: cr
html: html htm
css: css
scss: scss
sass: sass
less: less
stylus: styl
xml: xml xsl xslt
json: json
yaml: yaml yml
toml: toml
ini: ini cfg conf
sql: sql
prisma: prisma
graphql: graphql gql
terraform: tf tfvars
protobuf: proto
shell: sh bash zsh
powershell: ps1 psm1 psd1
batch: bat cmd
markdown: md markdown mdx
restructuredtext: rst
""".strip().splitlines()
#: Node type by what a pattern's text contains, the first that applies.
TYPE_WORDS = [
    ("class", "class_declaration", "class"), ("interface", "interface_declaration", "interface"), ("function", "function_declaration", "function"),
    ("def", "function_declaration", "function"), ("fn", "function_declaration", "function"), ("type", "type_alias_declaration", "type"),
    ("enum", "type_alias_declaration", "type"), ("struct", "struct_declaration", "class"), ("trait", "trait_declaration", "interface"),
    ("const", "variable_declaration", "variable"), ("let", "variable_declaration", "variable"), ("module", "module_declaration", "namespace"),
    ("namespace", "module_declaration", "namespace"), ("impl", "impl_declaration", "class"),
]
