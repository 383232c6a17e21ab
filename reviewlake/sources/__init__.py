"""Readers of change sets, reports, histories, tool output and stores."""
