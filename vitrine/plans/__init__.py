"""Putting operators together: input bindings, dashboard sections, named queries."""
