"""Column builders: everything here is a Column or builds one."""
