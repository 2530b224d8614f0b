"""Column expressions and batch functions on windows of counts."""
