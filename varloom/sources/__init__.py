"""Readers and writers of variant tables and their payloads."""
