"""Schemas of the property graph, findings and runs. Union-typed node data is one sparse struct, told by kind."""

from __future__ import annotations

PARAMETER = "struct<name:string,param_type:string,default_value:string>"
DATA = (
    f"struct<language:string,exports:array<string>,parameters:array<{PARAMETER}>,return_type:string,base_classes:array<string>,methods:array<string>,"
    "fields:array<string>,definition:string,var_type:string,is_constant:boolean,module:string,imported_names:array<string>,resolved_path:string,"
    "http_method:string,path:string,handler:string,table_name:string,model_fields:array<struct<name:string,field_type:string,nullable:boolean>>,key:string,default_value:string>"
)
METADATA = "struct<call_line:int,is_direct:boolean,alias:string,is_wildcard:boolean,param_index:int>"
NODES = f"snapshot string, id bigint, kind string, name string, file_path string, line int, end_line int, is_public boolean, data {DATA}, decorators array<string>, type_parameters array<string>"
EDGES = f"snapshot string, from_id bigint, to_id bigint, edge_idx int, kind string, metadata {METADATA}"
FINDINGS = "id string, prefix string, severity string, message string, file string, line int, affected_dependents int, suggestion string, fix struct<kind:string,find:string,replace:string>, callers array<string>, ai_note string, ai_false_positive boolean"
RUN = (
    "id string, version string, timestamp bigint, duration_secs double, files_analyzed int, nodes_parsed int, summary struct<errors:int,warnings:int,info:int,suppressed:int>, "
    "findings array<struct<id:string,severity:string,message:string,file:string,line:int,suppressed:boolean,suppression_reason:string>>"
)
#: The kinds that the graph knows.
NODE_KINDS = ("File", "Module", "Class", "Interface", "Function", "Variable", "Import", "Type", "APIEndpoint", "DatabaseModel", "ConfigReference")
EDGE_KINDS = ("Contains", "Imports", "Calls", "Inherits", "Implements", "References", "ReturnsType", "AcceptsParam", "ReadsConfig", "QueriesModel", "ExposesEndpoint")
