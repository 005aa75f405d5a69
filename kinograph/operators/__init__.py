"""The operators: functions of a scope, anchor frames and parameters, to lazy frames."""
