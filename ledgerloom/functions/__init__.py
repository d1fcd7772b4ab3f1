"""Column expressions shared by the operators, and the one per-document helper (``html_tree``)."""
