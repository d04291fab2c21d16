"""quirel.operators"""
