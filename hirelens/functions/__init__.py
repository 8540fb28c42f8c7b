"""Column functions: text, salaries, roles, weeks, sections."""
