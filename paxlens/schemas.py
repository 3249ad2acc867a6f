"""Table schemas, as DDL."""

SOURCE_FILES = "package_id string, data_type string, rel_path string, size long, code string"
ASTS = "package_id string, data_type string, rel_path string, success boolean, parser string, ast string, error string"

NODE_FIELDS = (
    "node_seq int, node_id string, type string, label string, callee_name string, is_chained boolean, is_member_call boolean, "
    "call_depth int, chain_position string, is_constructor boolean, arg_index int, content string, function_name string, "
    "is_async boolean, is_generator boolean, is_callback boolean, class_name string, parameter_name string"
)
EDGE_FIELDS = "edge_seq int, src string, dst string, type string"
GRAPHS = f"package_id string, data_type string, rel_path string, nodes array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in NODE_FIELDS.split(', ')))}>>, edges array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in EDGE_FIELDS.split(', ')))}>>, error string, seconds double, at timestamp"
GRAPH_NODES = f"package_id string, file_key string, {NODE_FIELDS}"
GRAPH_EDGES = f"package_id string, file_key string, {EDGE_FIELDS}"
FAILURES = "package_id string, rel_path string, stage string, error_type string, error_message string"
ATOMIC_RULES = "sample string, sample_ord int, rule_ord int, rule_id string, name string, category string, node_type string, callee_name_regex string, content_regex string, content string"

# The order of the graph features in result tables.
GRAPH_FEATURES = (
    "malicious_node_count", "malicious_ratio", "category_diversity", "IG_ratio", "DT_ratio", "DE_ratio", "PE_ratio", "SP_ratio",
    "malicious_internal_edges", "malicious_density", "malicious_components", "mean_degree_centrality_full", "max_degree_centrality_full",
    "mean_malicious_pagerank", "max_malicious_pagerank", "sum_malicious_pagerank", "mean_malicious_betweenness", "max_malicious_betweenness",
    "mean_degree_centrality_sub", "max_degree_centrality_sub", "mean_pagerank_sub", "max_pagerank_sub", "mean_betweenness_sub", "max_betweenness_sub",
    "num_malicious_communities", "max_community_maliciousness_ratio", "malicious_community_entropy",
)
CODES = ("IG", "DT", "DE", "PE", "SP")
