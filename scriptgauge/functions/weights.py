"""Default weight of each factor per dialect, in long form for users to replace."""

FACTORS = (
    "table join where_condition subquery aggregate_function case_expression set_operation group_by order_by "
    "loop nested_loop custom_function high_weight_table nested_procedure high_weight_procedure "
    "cursor_declaration cursor_operation nested_cursor "
    "lateral_view distribute_by cluster_by sort_by partition_by window_function "
    "dynamic_sql parameter_binding nested_dynamic_sql "
    "transaction_control autonomous_transaction nested_transaction "
    "java_procedure type_conversion package_procedure package_variable "
    "cursor_with_query cursor_for_update"
).split()

DEFAULTS = {
    "Oracle": {
        "table": 1.0, "join": 2.0, "where_condition": 1.5, "subquery": 3.0, "aggregate_function": 1.0,
        "case_expression": 1.0, "set_operation": 2.0, "group_by": 1.5, "order_by": 1.0,
        "loop": 2.5, "nested_loop": 1.5, "custom_function": 2.0, "high_weight_table": 2.0,
        "nested_procedure": 3.0, "high_weight_procedure": 2.5,
        "cursor_declaration": 2.0, "cursor_operation": 1.5, "nested_cursor": 1.5,
    },
    "Gauss": {
        "table": 10.0, "join": 15.0, "where_condition": 5.0, "subquery": 20.0, "aggregate_function": 10.0,
        "case_expression": 5.0, "set_operation": 15.0, "group_by": 5.0, "order_by": 5.0,
        "loop": 15.0, "nested_loop": 20.0, "custom_function": 10.0, "high_weight_table": 20.0,
        "nested_procedure": 15.0, "high_weight_procedure": 20.0,
        "cursor_declaration": 10.0, "cursor_operation": 5.0, "nested_cursor": 15.0,
        "dynamic_sql": 15.0, "parameter_binding": 5.0, "nested_dynamic_sql": 25.0,
        "transaction_control": 10.0, "autonomous_transaction": 15.0, "nested_transaction": 20.0,
        "java_procedure": 25.0, "type_conversion": 5.0, "package_procedure": 5.0, "package_variable": 2.0,
    },
    "Hive": {
        "table": 1.0, "join": 2.0, "where_condition": 1.5, "subquery": 3.0, "aggregate_function": 1.0,
        "case_expression": 1.5, "set_operation": 2.0, "group_by": 1.5, "order_by": 1.0,
        "lateral_view": 2.0, "distribute_by": 1.5, "cluster_by": 1.5, "sort_by": 1.0,
        "partition_by": 1.5, "window_function": 2.5,
    },
}
STATEMENT_KIND_FACTOR = {"INSERT": 1.0, "UPDATE": 1.2, "DELETE": 1.1, "MERGE": 1.5}


def rows() -> list[tuple[str, str, float]]:
    return [(dialect, factor, weight) for dialect, table in DEFAULTS.items() for factor, weight in table.items()]
