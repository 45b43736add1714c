"""Column expressions shared by readers and operators."""
