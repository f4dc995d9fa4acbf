"""Table schemas."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name.rstrip("_"), kind) for name, kind in columns.items()])


CHUNKS = _table(id=_S, path=_S, content=_S, start_line=_I, end_line=_I, kind=_S, symbols=T.ArrayType(_S), references=T.ArrayType(_S), file_hash=_S, created_at=T.TimestampType(), doc_comment=_S, signature=_S, breadcrumb=_S, token_count=_I, language=_S, content_hash=_S, generated_description=_S, conformances=T.ArrayType(_S), is_type_declaration=_B)
SNIPPETS = _table(id=_S, path=_S, content=_S, start_line=_I, end_line=_I, breadcrumb=_S, token_count=_I, language=_S, chunk_id=_S, kind=_S, file_hash=_S, created_at=T.TimestampType())
VECTORS = _table(id=_S, embedding=T.ArrayType(T.FloatType()))
FILE_HASHES = _table(path=_S, hash=_S, indexed_at=T.TimestampType())
MANIFEST = _table(name=_S, size=_L, compressed_size=_L, checksum=_S)
AST_NODES = _table(node_id=_I, parent_id=_I, depth=_I, kind=_S, name=_S, start_line=_I, end_line=_I, signature=_S)
RESULTS = _table(query_id=_S, chunk_id=_S, path=_S, kind=_S, start_line=_I, end_line=_I, score=_D, bm25_score=_D, semantic_score=_D, bm25_rank=_I, semantic_rank=_I, is_multi_hop=_B, hop_depth=_I, exact_symbol_match=_B, relevance_percent=_I)

# Chunk kinds and snippet kinds.
CHUNK_KINDS = (
    "function method initializer deinitializer subscript class struct enum protocol extension actor macro typealias variable constant "
    "objcInterface objcImplementation objcMethod objcProperty objcCategory cFunction cStruct cTypedef cMacro "
    "jsonObject jsonArray yamlMapping yamlSequence markdownSection markdownCodeBlock comment section document namespace file interface unknown"
).split()
SNIPPET_KINDS = "documentation markdownSection apiDocumentation example annotation".split()
