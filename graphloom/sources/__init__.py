"""Sources and sinks: text and binary graph files, partition files, tables, generators."""
