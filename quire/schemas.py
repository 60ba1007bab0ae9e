"""Fixed schemas of the object tables.

One row per node, never nested documents: a value inside an object is an
``entries`` row addressed by ``path`` (steps from the object's root). The row
with the empty path describes the object's own value.
"""

from __future__ import annotations

DOCS = (
    "doc_id string, path string, size bigint, mtime timestamp, page_count int, "
    "encrypted boolean, has_file_id boolean, catalog_id string, info_id string"
)
OBJECTS = (
    "doc_id string, obj_id string, obj_num bigint, gen int, status string, "
    "offset bigint, host_objstm bigint, type_name string"
)
ENTRIES = (
    "doc_id string, obj_id string, path array<string>, parent_path array<string>, "
    "key string, idx bigint, node_type string, value_type string, value_raw string, "
    "value string, num double, ref_id string"
)
EDGES = "doc_id string, src_id string, dst_id string, path string, ord array<string>"
TOKENS = (
    "doc_id string, page_num bigint, stream_idx int, tok_idx bigint, type string, "
    "value string, line bigint, col bigint"
)
CERTS = (
    "doc_id string, field_name string, cert_idx int, subject string, issuer string, "
    "serial string, ski string, not_before timestamp, not_after timestamp, ku_bits int, "
    "eku array<string>, crl array<string>, ocsp array<string>, ca_issuers array<string>"
)
SIGNER_INFOS = (
    "doc_id string, field_name string, sid_kind string, issuer string, serial string, "
    "ski string, digest_oid string, sig_oid string"
)
STAGES = "doc_id string, obj_id string, stage int, filter string, size bigint"
DISK_OBS = "key string, ts timestamp, state string, disk_mtime bigint, disk_size bigint"
