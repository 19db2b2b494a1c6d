"""Operators for training text and record matching. Nothing else in the
package imports this one."""
