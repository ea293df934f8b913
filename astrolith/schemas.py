"""Schemas of the scan table and of the tables derived from it."""

from __future__ import annotations

REF = "struct<name:string,kind:string,line:int>"
DECLARATION = f"struct<idx:int,parent:int,path:string,leaf:string,kind:string,s_line:int,e_line:int,s_byte:bigint,e_byte:bigint,col:int,body_byte:bigint,indent:int,signature:string,preview:string,refs:array<{REF}>>"
IMPORT = "struct<name:string,source:string,line:int>"
EDGE = "struct<ord:int,module:string,names:array<string>,scope:string,line:int,level:int>"
METHOD = "struct<name:string,line:int,lines:int,complexity:int,max_depth:int,is_async:boolean>"
EXPORT = f"struct<name:string,kind:string,line:int,lines:int,complexity:int,max_depth:int,internal_refs:int,methods:array<{METHOD}>>"
COUNTERS = "struct<functions:int,methods:int,classes:int,callable_lines:int,typed_functions:int,args:int,typed_args:int,attrs:int,typed_attrs:int,vars:int,typed_vars:int>"
#: One row a file; whatever needs a syntax tree is in it.
SCAN = (
    f"file string, language string, module string, length bigint, parse_error string, declarations array<{DECLARATION}>, imports array<{IMPORT}>, edges array<{EDGE}>, exports array<{EXPORT}>, "
    "guards array<struct<line:int,call:string>>, calls array<struct<line:int,call:string,leaf:string>>, handlers array<struct<line:int,type:string,context:string>>, "
    f"defs map<string,int>, counters {COUNTERS}, init_code boolean"
)
FINDING = "section string, message string, detail string, severity string, sev_ord int, location string"
SEVERITY = {"skip": -1, "debug": 0, "info": 1, "warning": 2, "error": 3, "critical": 4}
