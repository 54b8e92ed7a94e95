"""Column expressions: everything here stays inside code generation unless it says otherwise."""
