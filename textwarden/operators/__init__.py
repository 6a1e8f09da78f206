"""Jobs: functions from DataFrame to DataFrame, without actions inside."""
