"""Readers that turn source trees and logs into flat tables."""
